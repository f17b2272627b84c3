"""CSV files that get their names when a job is done."""

import csv

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.sources.named_csv import NamedCsvWriter, write_named_csv


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_files_rows_and_order(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit('a,"b"\n'), "id")).alias("t")).repartition(5)
    write_named_csv(df, str(out), F.concat(F.lit("file-"), "g", F.lit(".csv")), [-F.col("n")], ["n", "t"], always=["file-9.csv"])
    assert sorted(p.name for p in out.iterdir()) == ["file-0.csv", "file-1.csv", "file-2.csv", "file-9.csv"]
    for g in range(3):
        want = [[str(n), f'a,"b"\n{n}' if n % 7 else ""] for n in sorted(range(g, 300, 3), reverse=True)]
        assert rows_of(out / f"file-{g}.csv") == [["n", "t"], *want]
    assert rows_of(out / "file-9.csv") == [["n", "t"]]
    write_named_csv(df.where("g = 1"), str(out), F.lit("file-1.csv"), [F.col("n")], ["n"], replaces=["file-[0-2].csv"])
    assert sorted(p.name for p in out.iterdir()) == ["file-1.csv", "file-9.csv"] and len(rows_of(out / "file-1.csv")) == 101


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.range(10).select(F.lit("a.csv").alias("f"), "id")
    write_named_csv(good, str(out), F.col("f"), [F.col("id")], ["id"])
    bad = spark.range(1000).repartition(4).select(F.concat(F.lit("b"), F.col("id") % 5).alias("f"), F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        write_named_csv(bad, str(out), F.col("f"), [F.col("f")], ["x"], replaces=["a.csv"])
    assert [p.name for p in out.iterdir()] == ["a.csv"]


def test_a_task_that_ran_twice_counts_once(spark, tmp_path):
    writer = NamedCsvWriter({"path": str(tmp_path / "out")}, spark.range(1).select(F.lit("x").alias("_file"), "id").schema)
    batch = pa.RecordBatch.from_arrays([pa.array(["x.csv"] * 3), pa.array([1, 2, 3])], ["_file", "id"])
    first, _ = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([first, None])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["x.csv"] and rows_of(tmp_path / "out" / "x.csv") == [["id"], ["1"], ["2"], ["3"]]
