"""Design matrices that are frozen when a model is fitted: centre and scale of numbers, codes of categories; the same for training, scoring and recursion."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standardised values are cut here. Fixed value.
CUT = 6.0
#: Code of a category that the fit hasn't seen.
UNSEEN = -1


@dataclass
class Design:
    """Numeric features with their centre and (population) scale, and the levels of categorical ones in order."""

    features: list[str]
    center: np.ndarray
    scale: np.ndarray
    levels: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], categories: list[str] | None = None, most_levels: int = 10_000) -> Design:
        """One aggregate over all rows. A constant or empty feature has scale 1; nulls and NaN don't count. Levels are the distinct values that aren't null: more of
        them than most_levels (a column that is no category) are an error, as they go to the driver and into expressions."""
        known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        got = rows.agg(*[F.avg(known(c)).alias(f"m_{c}") for c in features], *[F.stddev_pop(known(c)).alias(f"s_{c}") for c in features], F.count("*").alias("n")).first()
        levels = {}
        for c in categories or []:
            found = [r[0] for r in rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().orderBy(c).limit(most_levels + 1).collect()]
            if len(found) > most_levels:
                raise ValueError(f"{c} has more than {most_levels} levels")
            levels[c] = found
        return cls(list(features), np.array([got[f"m_{c}"] or 0.0 for c in features]), np.array([got[f"s_{c}"] or 1.0 for c in features]), levels)

    def number(self, name: str) -> Column:
        """A feature, standardised and cut; 0, the centre, where it is null or NaN."""
        k = self.features.index(name)
        value = F.nanvl(F.coalesce(F.col(name).cast("double"), F.lit(float(self.center[k]))), F.lit(float(self.center[k])))
        return F.least(F.greatest((value - float(self.center[k])) / float(self.scale[k]), F.lit(-CUT)), F.lit(CUT))

    def code(self, name: str) -> Column:
        """A category's place among the levels; UNSEEN for others and null."""
        own = self.levels[name]
        codes = F.create_map(*[F.lit(x) for pair in zip(own, range(len(own)), strict=True) for x in pair]) if own else F.create_map().cast("map<string,int>")
        return F.coalesce(F.try_element_at(codes, F.col(name).cast("string")), F.lit(UNSEEN))

    def row(self, names: list[str] | None = None) -> Column:
        """A constant and the standardised features, as an array."""
        return F.array(F.lit(1.0), *[self.number(c) for c in names or self.features])

    def matrix(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, const, and each feature under its name: the count part of a design; categories as codes."""
        return rows.select(*keep, F.lit(1.0).alias("const"), *[self.number(c).alias(f"z_{c}") for c in self.features], *[self.code(c).alias(f"code_{c}") for c in self.levels])

    def values(self, rows: np.ndarray, names: list[str] | None = None) -> np.ndarray:
        """The same for rows of raw numbers in a task, in the order of features: constant first."""
        at = [self.features.index(c) for c in names or self.features]
        raw = np.where(np.isnan(rows[:, at]), self.center[at], rows[:, at])
        return np.column_stack([np.ones(len(rows)), np.clip((raw - self.center[at]) / self.scale[at], -CUT, CUT)])
