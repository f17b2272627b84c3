"""Mixing and sharding against their laws."""

import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.llm import sharding
from skyloom.llm.mixing import mix_sources, mixed_documents, sized_documents, source_targets
from skyloom.llm.sharding import find_splitters, histogram_sort


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by pouring again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        heavy = sum(w[s] for s in names if s not in capped)
        level = rest / heavy if heavy else 0
        new = {s for s in names if s not in capped and level * w[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= new


def documents(spark, seed=0, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "é", "Z", "tiny", None])
        words = 2 if source == "tiny" else rng.choice([1, 5, 30])
        rows.append((i, " ".join(["w"] * words) if i % 50 else None, source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(spark):
    rows, df = documents(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    got = mix_sources(sized_documents(df).cache()).collect()
    want = fill(sizes)
    assert len(got) == len(rows)
    for s, total in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == total and r["target"] == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r["size"] * r["copies"] for r in mine) - want[s]) <= 31
        assert max(r["copies"] for r in mine) <= 3
    again = mix_sources(sized_documents(df.orderBy(F.rand())).cache()).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}


def test_smaller_budgets_are_nested(spark):
    _, df = documents(spark, 1)
    sized = sized_documents(df).cache()
    few, many = ({r["doc_id"]: r["copies"] for r in mix_sources(sized, budget=b).collect()} for b in (0.3, 0.9))
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())


def test_mixed_documents_repeat_rows(spark):
    _, df = documents(spark, 2)
    taken = {r["doc_id"]: r["copies"] for r in mix_sources(sized_documents(df).cache()).collect()}
    got = {}
    for r in mixed_documents(df.withColumn("hash", F.lit("x"))).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in taken.items() if n}


def test_clashing_names_come_through(spark):
    _, df = documents(spark, 3)
    clash = {c: F.lit(7) for c in ("s", "rounds", "threshold", "copies", "target", "_h", "few", "rest")}
    plain = {r["doc_id"]: r["copies"] for r in mix_sources(sized_documents(df)).collect()}
    got = mix_sources(sized_documents(df.withColumns(clash), *clash)).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == plain and all(r["s"] == r["rounds"] == r["_h"] == 7 for r in got)
    mixed = mixed_documents(df.withColumns(clash))
    assert mixed.columns == df.withColumns(clash).columns and mixed.count() == sum(plain.values())
    wide = df.withColumns({c: F.lit(c) for c in ("_h", "_t", "_size", "_part", "slot", "shard", "_0")})
    out = histogram_sort(wide, F.xxhash64("text"), F.col("doc_id"), F.lit(1), 5)
    assert set(out.columns) == set(wide.columns) and out.count() == df.count()
    r = out.first()
    assert r["_h"] == "_h" and r["_part"] == "_part" and r["_0"] == "_0" and isinstance(r["slot"], int)


def test_targets_equal_sql(spark):
    """Sizes by source and targets without caps, by DuckDB on the same rows."""
    import duckdb

    rows, df = documents(spark, 4)
    table = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    sql = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM table_),
    s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s)
    SELECT doc_id, size, source_size, w * (SELECT sum(source_size) FROM w) / (SELECT sum(w) FROM w) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source"""
    con = duckdb.connect()
    con.register("table_", table)
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    for r in mix_sources(sized_documents(df), cap=1000).collect():
        size, source_size, target = want[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, source_size) and r["target"] == pytest.approx(target)


def test_mixing_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(sized_documents(none)).count() == 0 and mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mix_sources(sized_documents(blank)).collect()] == [0, 0]
    sizes = spark.createDataFrame([("only", 7)], "source string, source_size long")
    assert source_targets(sizes, (5, 2, 1), 1.0, 3).first()["target"] == 7


def shards_of(spark, rows, shards, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    return histogram_sort(df, F.xxhash64("text"), F.col("doc_id"), F.col("size"), shards, **more).collect()


def test_shards_are_even(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice("abc") * rng.randrange(60)) for i in range(4000)] + [(None, None), (7, "hot"), (7, "hot")]
    got = shards_of(spark, rows, 40)
    assert len(got) == len(rows)
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in v) for v in held.values()]
    assert set(held) == set(range(40)) and max(sizes) - min(sizes) <= 2 * 80 + 0.01 * sum(sizes) / 40
    for v in held.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))


def test_one_exchange_of_rows(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text")
    plan = histogram_sort(df, F.xxhash64("text"), F.col("doc_id"), F.octet_length("text"), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_shards_of_several_tasks(spark, monkeypatch):
    """Shards of more rows than a task takes are cut finer; slots go on over their tasks."""
    monkeypatch.setattr(sharding, "ROWS_A_TASK", 60)
    rows = [(i, f"text {i % 700} " * (i % 9)) for i in range(3000)]
    held = {}
    for r in shards_of(spark, rows, 6):
        held.setdefault(r["shard"], []).append(r)
    assert set(held) == set(range(6)) and sum(map(len, held.values())) == 3000
    sizes = [sum(r["size"] for r in v) for v in held.values()]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 6 + 200
    for v in held.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))


def test_equal_texts_stay_together_where_they_fit(spark):
    rows = [(i, f"text {i // 4}") for i in range(8000)]
    got = shards_of(spark, rows, 8, tolerance=0.01)
    places = {}
    for r in got:
        places.setdefault(zlib.crc32(r["text"].encode()), set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values())


def test_sharding_of_odd_tables(spark):
    assert shards_of(spark, [], 5) == []
    one = shards_of(spark, [(1, "x")], 5)
    assert len(one) == 1 and one[0]["slot"] == 0
    same = shards_of(spark, [(3, "x")] * 10, 4)
    assert sorted(r["slot"] for r in same) == list(range(10)) and len({r["shard"] for r in same}) == 1
    keys = spark.createDataFrame([(-(2**63), 0, 5), (2**63 - 1, 0, 5), (0, 0, 5), (0, 1, 5)], "_h long, _t long, _size long")
    cuts, total = find_splitters(keys, 4, 0.001)
    assert total == 20 and len(cuts) == 3 and cuts == sorted(cuts)
