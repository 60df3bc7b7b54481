"""Keyed work in batches that can be stopped at any time and goes on where it stopped.

Keys are dealt to batches by hash. A batch takes the keys that no finished attempt has, works on their rows, and writes the results to a
folder of its own, which is given its final name when it is complete: a rename, so a killed run leaves nothing that counts. The next run finds the
unfinished keys again by an anti join. If two runs should work on one key at the same time, the result of the attempt of the lesser name
counts, whole, for every reader. Results are JSON lines, as checkpoints are elsewhere."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.tables import exists, unfinished

BATCHES = 16
_ATTEMPT = "__attempt"


def finished(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The results of all finished attempts, one attempt's for each key; empty where there is none."""
    if not exists(spark, f"{path}/done"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(f"{path}/done/*").withColumn(_ATTEMPT, F.element_at(F.split(F.input_file_name(), "/"), -2))
    first = rows.groupBy(key).agg(F.min(_ATTEMPT).alias("__first"))
    return rows.join(first, key).where(F.col(_ATTEMPT) == F.col("__first")).select(*schema.names)


def commit(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """Write rows as an attempt, then give it its final name, which is returned."""
    name = uuid.uuid4().hex
    rows.write.json(f"{path}/trying/{name}")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    source, target = jvm(f"{path}/trying/{name}"), jvm(f"{path}/done/{name}")
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(jvm(f"{path}/done"))
    if not system.rename(source, target):
        raise OSError(f"an attempt could not be finished: {path}/done/{name}")
    return name


def run(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, batches: int = BATCHES, most: int | None = None) -> DataFrame:
    """The results of work for every key of df (null is none), all that earlier runs have finished included. work gets the rows of a batch's
    keys and returns rows with the key. most: stop after so many batches that had something to do."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in work(df.limit(0)).schema.fields])
    done = 0
    for k in range(batches):
        if most is not None and done >= most:
            break
        own = df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        left = unfinished(own, finished(spark, path, key, schema), key)
        if left.isEmpty():
            continue
        commit(spark, path, work(own.join(left, key, "left_semi")))
        done += 1
    return finished(spark, path, key, schema)
