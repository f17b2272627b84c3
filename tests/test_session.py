"""Staged tables and shared folders go when they are done with."""

import subprocess
import sys
from pathlib import Path

from skyloom.session import scratch, settled, shared_path, staged, unstage

ROOT = Path(__file__).resolve().parent.parent


def there(df):
    return Path(df._staged_path.removeprefix("file:")).exists()


def test_scopes(spark):
    with scratch():
        first = staged(spark.range(5), "a")
        inner = []

        def make():
            inner.append(staged(first.selectExpr("id + 1 AS id"), "b"))
            return inner[0].where("id > 2")

        kept = settled(make, "c")
        assert there(first) and there(kept) and not there(inner[0])
        assert sorted(r["id"] for r in kept.collect()) == [3, 4, 5]
    assert not there(first) and not there(kept)
    alone = staged(spark.range(3), "d")
    unstage(alone)
    assert not there(alone)
    unstage(spark.range(3))  # what is not staged stays


def test_nothing_is_left_behind(tmp_path):
    code = f"""
from skyloom.session import local_session, shared_path, staged
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
staged(spark.range(5), "a")
spark.range(5).write.parquet(shared_path(spark, "b"))
spark.range(5).write.parquet(shared_path(spark, "c", keep=True))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, timeout=120)
    left = {p.name.split("-")[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))}
    assert left == {"c"}
