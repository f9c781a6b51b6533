"""Memory that executors give back between the stages of the pipeline."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

import corpus_pipeline

CLUSTER = """
import re, sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from kobza.llm import common

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "900m").config("spark.ui.enabled", "false").getOrCreate()

def memory():
    found = []
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if str(spark.sparkContext.applicationId).encode() in (c := (p / "cmdline").read_bytes()) and b"CoarseGrainedExecutorBackend" in c and c.split(b"\\0")[0].endswith(b"java"):
                found.append(int(re.search(r"Pss_Anon:\\s+(\\d+)", (p / "smaps_rollup").read_text())[1]) // 1024)
        except OSError:
            pass
    return sorted(found)

spark.range(0, 4, 1, 4).selectExpr("size(transform(sequence(1, 3000000), x -> cast(x + id as string))) as n").agg({"n": "sum"}).collect()
before = memory()
common.shrink_executors(spark)
time.sleep(1)
print("MEMORY", *before, *memory())
spark.stop()
"""


def test_executors_give_memory_back(tmp_path):
    home = Path(__file__).parents[2]
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (tmp_path / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": f"{home}:{os.environ.get('PYTHONPATH', '')}", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(tmp_path), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    run = subprocess.run([sys.executable, "-c", CLUSTER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert "MEMORY" in run.stdout, run.stderr[-2000:]
    a, b, c, d = map(int, run.stdout.rpartition("MEMORY")[2].split())
    assert c + d < 0.7 * (a + b), (a, b, c, d)


def test_every_stage_begins_with_lean_executors(monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "shrink_executors", calls.append)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage(None, None, "")
        except Exception:
            pass
    assert len(calls) == len(corpus_pipeline.STAGES) == 5
