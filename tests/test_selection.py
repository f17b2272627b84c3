"""Order statistics of large and small groups against sorted arrays."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import selection
from skyloom.operators.selection import group_statistics, order_statistics, quantiles, silverman_bandwidths


@pytest.fixture
def fine(monkeypatch):
    """Histograms from 50 rows on, so that small tables take every step."""
    monkeypatch.setattr(selection, "SORTED_ROWS", 50)
    monkeypatch.setattr(selection, "BUCKETS", 16)


def uneven(n=6000):
    rng = np.random.default_rng(4)
    return {
        "normal": rng.normal(0, 1, n), "wide": np.exp(rng.normal(0, 40, n // 2)) * rng.choice([-1, 1], n // 2), "same": np.full(900, 2.5),
        "ends": np.array([-math.inf, math.inf, math.nan, 0.0, -0.0, 5e-324, -1.7e308] * 60), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0]),
        "close": 1 + rng.integers(0, 5000, 2000) * 2.0**-52,
    }


def table(spark, groups):
    df = pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in groups.items()])
    return spark.createDataFrame([*map(tuple, df.itertuples(index=False)), ("few", None), ("none", None), (None, 4.0), (None, 6.0)], "g string, x double")


def test_places_of_all_kinds_of_groups(spark, fine):
    groups = uneven()
    places = {"first": F.lit(0), "q1": F.floor(F.col("n") / 4), "middle": F.floor(F.col("n") / 2), "q3": F.floor(F.col("n") * 3 / 4), "last": F.col("n"), "below": F.lit(-3)}
    got = {r["g"]: r for r in order_statistics(table(spark, groups), ["g"], "x", places).collect()}
    assert set(got) == {*groups, None}
    for g, x in groups.items():
        n, x = len(x), np.sort(x)  # NaN last
        assert got[g]["n"] == n
        for c, k in (("first", 0), ("q1", n // 4), ("middle", n // 2), ("q3", 3 * n // 4), ("last", n - 1), ("below", 0)):
            assert got[g][c] == x[k] or math.isnan(got[g][c]) and math.isnan(x[k]), (g, c)
    assert (got[None]["first"], got[None]["last"]) == (4, 6)


def test_quantiles_and_moments(spark, fine):
    groups = {g: x for g, x in uneven().items() if g != "ends"}
    got = {r["g"]: r for r in group_statistics(table(spark, groups), ["g"], "x", {"p0": -5, "p10": 10, "p50": 50, "p99": 99, "p100": 200}).collect()}
    for g, x in groups.items():
        want = np.percentile(x, [0, 10, 50, 99, 100])
        assert np.allclose([got[g][c] for c in ("p0", "p10", "p50", "p99", "p100")], want, rtol=1e-12)
        assert got[g]["mean"] == pytest.approx(x.mean(), rel=1e-9, abs=1e-12)
        assert got[g]["std"] == pytest.approx(x.std(ddof=1) if len(x) > 1 else 0, rel=1e-9, abs=1e-12)
    assert got[None]["p50"] == 5


def test_bandwidths(spark, fine):
    groups = {g: x for g, x in uneven().items() if g in ("normal", "same", "few", "one", "close")}
    got = {r["g"]: r["h"] for r in silverman_bandwidths(table(spark, groups).where("g is not null"), ["g"], "x").collect()}
    for g, x in groups.items():
        x = np.sort(x)
        if len(x) < 2:
            assert got[g] == 0.5
            continue
        std, iqr = x.std(ddof=1), (x[3 * len(x) // 4] - x[len(x) // 4]) / 1.34
        assert got[g] == pytest.approx(0.9 * (std if min(std, iqr) < 1e-10 else min(std, iqr)) * len(x) ** -0.2, rel=1e-3, abs=1e-18)


def test_without_groups_and_without_rows(spark, fine):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert quantiles(df, [], "x", {"p50": 50, "p25": 25}).first()[:] == (1000, 499.5, 249.75)
    assert quantiles(df.where("x < 0"), [], "x", {"p50": 50}).count() == 0


def test_one_group_of_a_million_values(spark):
    """Only counts by bucket leave the tasks: nothing of the large group is sorted in one place."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 3).alias("x"))
    found = order_statistics(df, ["g"], "x", {"middle": F.floor(F.col("n") / 2)})
    assert found.first()["middle"] == 500_000 / 3
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_bandwidths_make_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(200).select((F.col("id") % 2).alias("g"), noted(F.col("id").cast("double")).alias("x"))
    assert selection.silverman_bandwidths(rows, ["g"], "x").count() == 2
    assert seen.value == 200
