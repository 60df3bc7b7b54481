"""Keyed batches: a run that is killed in the middle, and one that goes on."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tallyloom.sources import resume

SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from tallyloom.session import local_session
from tallyloom.sources import resume
spark = local_session(2, "killed")
df = spark.range(200).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("v"))
begun = 0
def work(rows):
    global begun
    begun += 1
    if begun == 5:  # the first call only asks for the schema: four batches are finished, the fifth writes its files and no more
        resume.commit = lambda spark, path, out: (out.write.json(path + "/trying/half"), os._exit(9))
    return rows.select("key", (F.col("v") + 1).alias("w"))
resume.run(df, "key", work, sys.argv[2], 8)
"""


def worked(log):
    def work(rows):
        log.append(rows)
        return rows.select("key", (F.col("v") + 1).alias("w"))

    return work


def test_killed_run_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/work"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ended = subprocess.run([sys.executable, "-c", SCRIPT, root, path], capture_output=True, timeout=240, check=False)
    assert ended.returncode == 9, ended.stderr[-2000:]
    df = spark.range(200).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("v"))
    df = df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None, 1)], "key string, v long"))
    schema = worked([])(df.limit(0)).schema
    before = {r.key for r in resume.finished(spark, path, "key", schema).collect()}
    assert 0 < len(before) < 200 and os.path.isdir(f"{tmp_path}/work/trying/half")
    log = []
    rows = resume.run(df, "key", worked(log), path, 8).collect()
    again = {r.key for part in log[1:] for r in part.collect()}
    assert len(os.listdir(f"{tmp_path}/work/done")) - len(log[1:]) == 4, "four batches had been finished"
    assert not again & before and again | before == {str(k) for k in range(200)}, "no finished key was worked on again"
    assert {r.key: r.w for r in rows} == {str(k): 2 * k + 1 for k in range(200)}
    # three rows had a repeated key: each keeps its rows, no key is lost or taken twice by attempts
    log = []
    assert resume.run(df, "key", worked(log), path, 8).count() == len(rows) and len(log) == 1


def test_attempts_at_one_key_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/both"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, w long")
    names = sorted(resume.commit(spark, path, rows.withColumn("w", F.col("w") + k)) for k in (10, 20))
    got = {r.key: r.w for r in resume.finished(spark, path, "key", rows.schema).collect()}
    first = spark.read.schema(rows.schema).json(f"{path}/done/{names[0]}").collect()
    assert got == {r.key: r.w for r in first}


def test_steps_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(str(k), k) for k in range(40)], "key string, v long")
    path = f"file://{tmp_path}/steps"
    counts = [resume.run(df, "key", worked([]), path, 8, most=3).count() for _ in range(3)]
    assert 0 < counts[0] < counts[1] < counts[2] == 40
    assert resume.run(df.limit(0), "key", worked([]), f"file://{tmp_path}/none", 8).count() == 0
