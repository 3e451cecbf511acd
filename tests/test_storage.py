"""Scratch data lives in the shared folder, one part an application, and goes with it."""

import os
import subprocess
import sys

from claimloom.storage import drop, scratch, stored


def test_paths_are_fresh_and_can_be_dropped(spark):
    first, second = scratch(spark, "a"), scratch(spark, "a")
    assert first != second and os.path.dirname(first) == os.path.dirname(second)
    assert os.path.dirname(first).startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(first)
    drop(spark, first)
    assert not os.path.exists(first)
    drop(spark, second)  # was never written


def test_stored_rows_outlive_their_source(spark):
    kept = stored(spark.range(5), "kept")
    assert sorted(r["id"] for r in kept.collect()) == list(range(5))


def test_an_application_leaves_nothing_behind(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from claimloom.storage import stored\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
        "import os\n"
        "stored(spark.range(5), 'kept').count()\n"
        f"print(sum(n.startswith('claimloom-') for n in os.listdir({str(tmp_path)!r})))\n"
        "spark.stop()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert ran.stdout.split()[-1:] == ["1"], ran.stderr[-2000:]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("claimloom-")]
