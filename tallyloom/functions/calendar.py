"""Calendar features of a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def month_start(date: Column) -> Column:
    return flag(F.dayofmonth(date) == 1)


def month_end(date: Column) -> Column:
    return flag(date == F.last_day(date))


def quarter_start(date: Column) -> Column:
    return flag(date == F.trunc(date, "quarter"))


def quarter_end(date: Column) -> Column:
    return flag(date == F.last_day(F.add_months(F.trunc(date, "quarter"), 2)))


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value of a given period."""
    turn = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(turn), F.cos(turn)


def features(date: Column) -> dict[str, Column]:
    """All calendar columns that the models use, by name."""
    week, day = F.weekofyear(date), weekday(date)
    dow_sin, dow_cos = cycle(day, 7)
    week_sin, week_cos = cycle(week, 52)
    return {
        "dow": day,
        "day": F.dayofmonth(date),
        "week": week,
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_weekend": flag(day >= 5),
        "is_month_start": month_start(date),
        "is_month_end": month_end(date),
        "is_quarter_start": quarter_start(date),
        "is_quarter_end": quarter_end(date),
        "is_q4": flag(F.quarter(date) == 4),
        "is_early_month": flag(F.dayofmonth(date) <= 5),
        "is_quarter_end_month": flag(F.month(date).isin(3, 6, 9, 12)),
        "is_peak_month": flag(F.month(date).isin(11, 12)),
        "is_last_weeks": flag(week >= 50),
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
        "week_sin": week_sin,
        "week_cos": week_cos,
    }


def week_ending_sunday(date: Column) -> Column:
    return F.next_day(F.date_sub(date, 1), "SUN")


def week_starting_monday(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))
