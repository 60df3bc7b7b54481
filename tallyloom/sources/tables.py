"""Readers and writers: by suffix, with explicit schemas, JSON-lines checkpoints, keyed column-wise upserts."""

from __future__ import annotations

import json
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical forecast table: fixed columns, in this order.
FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("product_key", T.StringType()),
        T.StructField("product_family_name", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("forecast_value", T.DoubleType()),
        T.StructField("p_sale", T.DoubleType()),
        T.StructField("generated_at", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet, csv or json-lines table by its suffix; another suffix is read as parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        return reader.option("header", True).option("escape", '"').csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Write by suffix as read_table reads; the path."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if path.endswith(".csv"):
        writer.option("header", True).option("escape", '"').csv(path)
    elif path.endswith((".json", ".jsonl")):
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def read_sheets(spark: SparkSession, paths: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Tables of one layout as one, each under its sheet's name; only the wanted columns are scanned."""
    parts = [read_table(spark, p).select(*(columns or ["*"])).withColumn("sheet", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


CHECKPOINT = T.StructType([T.StructField("desc", T.StringType()), T.StructField("result", T.StructType([T.StructField("family_name", T.StringType()), T.StructField("variant_hint", T.StringType())])), T.StructField("seq", T.LongType())])


def read_family_map(spark: SparkSession, path: str) -> DataFrame:
    """desc and family_name of a JSON-lines checkpoint: the row of the largest seq counts, a blank family is the description itself."""
    rows = spark.read.schema(CHECKPOINT).json(path).where("desc IS NOT NULL")
    last = rows.groupBy("desc").agg(F.max_by("result", F.coalesce("seq", F.lit(-1))).alias("result"))
    return last.select("desc", F.coalesce(F.nullif(F.trim("result.family_name"), F.lit("")), "desc").alias("family_name"), "result.variant_hint")


def upsert_columns(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join on keys in which new's other columns replace existing's of the same name."""
    replaced = {c.lower() for c in new.columns} - {k.lower() for k in keys}
    return existing.select(*[c for c in existing.columns if c.lower() not in replaced]).join(new, keys, "full_outer")


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def located(path: str, root: str) -> str:
    """A path as it is if it is absolute or a URI, else below root."""
    return path if path.startswith("/") or "://" in path or path.startswith("file:") else f"{root.rstrip('/')}/{path}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by the file system of the path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found))


def read_first(spark: SparkSession, stem: str, suffixes: tuple[str, ...] = (".parquet", ".csv", ".jsonl"), schema: T.StructType | None = None) -> DataFrame:
    """The table at stem with the first suffix that there is."""
    for suffix in suffixes:
        if exists(spark, stem + suffix):
            return read_table(spark, stem + suffix, schema)
    raise FileNotFoundError(f"no table at {stem} with any of {', '.join(suffixes)}")


def unfinished(df: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """The distinct keys of df that a checkpoint does not have yet; null is none."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(checkpoint.select(key), key, "left_anti")


class CachedTables:
    """The last few tables that were asked for, persisted; an older one is unpersisted when there are more."""

    def __init__(self, spark: SparkSession, most: int = 8) -> None:
        self.spark, self.most, self.held = spark, most, {}

    def get(self, path: str, columns: list[str] | None = None) -> DataFrame:
        key = (path, tuple(columns or ()))
        df = self.held.pop(key, None)
        if df is None:
            df = read_table(self.spark, path).select(*(columns or ["*"])).persist()
        self.held[key] = df
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        return df

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else Path(path).absolute().as_uri())


def write_manifest(path: str, content: dict) -> None:
    """A small JSON document at a path or URI, complete under its name or not there."""
    system, target = _place(path)
    system.create_dir(target.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{target}.part") as out:
        out.write(json.dumps(content, indent=2, sort_keys=True).encode())
    system.move(f"{target}.part", target)


def read_manifest(path: str) -> dict:
    """The document, or an empty one where there is none."""
    system, target = _place(path)
    if system.get_file_info(target).type == fs.FileType.NotFound:
        return {}
    with system.open_input_stream(target) as source:
        return json.loads(source.read())
