"""FITS tables that tasks write, filters that spare decoding, bit and variable-length columns."""

import math

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from skyloom.sources import fits

SCHEMA = "i long, j int, s short, d double, e float, b boolean, t string"
ROWS = [
    (1, 2, 3, 1.5, 2.5, True, "plain"), (None, None, None, None, None, None, None), (-(2**62), -5, -300, -0.0, 1e-30, False, "T"),
    (7, 2**31 - 1, 32767, math.inf, math.nan, True, ""), (8, 0, 0, math.nan, 0.0, False, "a longer text"),
]


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def test_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    fits.write_fits(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    got = {r["i"]: tuple(r) for r in fits.read_fits(spark, path).collect()}
    assert len(got) == len(ROWS)
    for row in ROWS:
        want = list(row)
        want[3], want[4], want[6] = (math.nan if row[3] is None else row[3]), (math.nan if row[4] is None else float(np.float32(row[4]))), row[6] or ""
        assert all(same(a, b) for a, b in zip(got[row[0]], want, strict=True)), (got[row[0]], want)
    fits.write_fits(spark.createDataFrame(ROWS[:1], SCHEMA), path)  # anew, in place of what was there
    assert fits.read_fits(spark, path).count() == 1 and len(list((tmp_path / "out").iterdir())) == 1
    spark.createDataFrame(ROWS[2:4], SCHEMA).write.format("fits").mode("append").save(path)
    assert fits.read_fits(spark, path).count() == 3


def test_empty_tables_single_letters_and_wrong_columns(spark, tmp_path):
    path = str(tmp_path / "out")
    fits.write_fits(spark.createDataFrame([], SCHEMA), path)
    assert fits.read_fits(spark, path).count() == 0 and len(fits.read_fits(spark, path).columns) == 7
    letters = [("T",), ("F",), ("T",)]
    fits.write_fits(spark.createDataFrame(letters, "x string"), path)
    assert sorted(map(tuple, fits.read_fits(spark, path).collect())) == sorted(letters)
    with pytest.raises(Exception, match="not ts timestamp"):
        fits.write_fits(spark.range(1).select(F.timestamp_seconds("id").alias("ts")), str(tmp_path / "no"))


def test_many_files_for_a_task(spark, tmp_path, monkeypatch):
    reader = fits.FitsWriter({"path": str(tmp_path / "w")}, spark.range(1).schema, True)
    monkeypatch.setattr(fits, "ROWS_A_PART", 10)
    import pyarrow as pa

    message = reader.write(iter([pa.RecordBatch.from_arrays([pa.array(range(a, a + 7))], ["id"]) for a in range(0, 35, 7)]))
    lost = reader.write(iter([pa.RecordBatch.from_arrays([pa.array([99])], ["id"])]))
    assert len(message.files) == 4 and len(lost.files) == 1
    reader.commit([message, None])  # a task that ran twice told of one run
    assert len(list((tmp_path / "w").iterdir())) == 4
    assert sorted(r["id"] for r in fits.read_fits(spark, str(tmp_path / "w")).collect()) == list(range(35))
    reader.abort([reader.write(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["id"])]))])
    assert len(list((tmp_path / "w").iterdir())) == 4


FILTERS = ["d > 0.25", "d >= 0.25 and i < 700", "i = 5", "i in (1, 2, 900)", "not (d > 0)", "e <= 0.5 or i = 3", "t = 'x7'", "i is null", "i is not null and d < 0.1", "d = double('NaN')", "d > 0.5 and t like 'x1%'", "5 < i and i <= 9"]


def test_filters_give_what_spark_gives(spark, tmp_path):
    df = spark.range(2000).selectExpr(
        "if(id % 50 = 0, null, id) AS i", "case when id % 40 = 0 then double('NaN') when id % 33 = 0 then 0.25D else (id * 37 % 1000) / 1000 - 0.3 end AS d", "float(id / 2000) AS e", "concat('x', id % 20) AS t"
    )
    path = str(tmp_path / "f")
    fits.write_fits(df.repartition(2), path)
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"
    for where in FILTERS:
        want, got = df.where(where), fits.read_fits(spark, path).where(where)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), where


def test_pushed_filters_spare_decoding(tmp_path):
    n = 30_000
    columns = {"ra": np.linspace(0, 360, n), **{f"c{k}": np.zeros(n) for k in range(20)}}
    path = tmp_path / "t.fits"
    path.write_bytes(fits.fits_table(columns))

    def read(filters):
        reader = fits.FilteringReader({"path": str(path)})
        left = list(reader.pushFilters(filters))
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        return rows, reader.decoded, left

    rows, every, _ = read([])
    some, spared, left = read([ds.GreaterThan(("ra",), 350.0), ds.StringContains(("ra",), "x"), ds.LessThan(("RA",), math.nan)])
    assert rows == n and some == np.sum(columns["ra"] > 350) and len(left) == 2
    assert spared < every / 10


def test_bits_and_variable_lengths(spark, tmp_path):
    """X, P and Q columns of a table that is written by hand."""
    heap = np.array([1.5, 2.5, 3.5], ">f8").tobytes() + b"name two" + np.array([9, -1], ">i4").tobytes()
    rows = []
    for bits, count, at, chars, where, ints, place in ((0b10110000, 2, 0, 4, 24, 2, 32), (0b01000000, 0, 0, 3, 29, 0, 0), (0b11111000, 1, 16, 0, 0, 1, 36)):
        rows.append(np.array([bits], "u1").tobytes() + np.array([count, at], ">i4").tobytes() + np.array([chars, where], ">i8").tobytes() + np.array([ints, place], ">i4").tobytes() + np.array([7], ">i2").tobytes())
    body = b"".join(rows) + heap
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(rows[0])), ("NAXIS2", 3), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", 5)]
    for i, (name, form) in enumerate([("BITS", "5X"), ("FAR", "1PD(2)"), ("TEXT", "1QA(8)"), ("INTS", "PJ(2)"), ("LAST", "I")], 1):
        cards += [(f"TTYPE{i}", f"'{name}'"), (f"TFORM{i}", f"'{form}'")]
    block = lambda cs: ("".join(f"{f'{k:<8}= {v}':<80}" for k, v in cs) + f"{'END':<80}").ljust(2880).encode()
    path = tmp_path / "heap.fits"
    path.write_bytes(block([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + block(cards) + body.ljust(2880, b"\0"))
    df = fits.read_fits(spark, str(path))
    assert dict(df.dtypes) == {"BITS": "array<boolean>", "FAR": "array<double>", "TEXT": "string", "INTS": "array<int>", "LAST": "int"}
    got = df.collect()
    assert [r["BITS"] for r in got] == [[True, False, True, True, False], [False, True, False, False, False], [True] * 5]
    assert [r["FAR"] for r in got] == [[1.5, 2.5], [], [3.5]] and [r["INTS"] for r in got] == [[9, -1], [], [-1]]
    assert [r["TEXT"] for r in got] == ["name", "two", ""] and [r["LAST"] for r in got] == [7, 7, 7]
