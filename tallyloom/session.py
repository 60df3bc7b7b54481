"""Session settings, the shared folder of a run, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the library's own sessions (tests, bench) set; a cluster's session keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, app: str = "tallyloom", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", "8g")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cpus), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only a local session may lack it; it then gets a temporary folder, set as its checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete what fresh_path() named since the last call: intermediate tables and files. For after a result was written elsewhere, as
    results are lazy and may still read them. Returns how many there were."""
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and a lost executor costs no more than a reread."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tallyloom-ship-"), "tallyloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
