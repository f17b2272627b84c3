"""Graphs that tasks reduce before the shuffle, and region pairs that meet by bands, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.functions.angles import lines_compatible
from skyloom.operators import clusters, graph, lines

CFG = DetectConfig()


def labels(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(5)
    yield "random", [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(None, 3), (4, None), (7, 7)]
    yield "dense", [(rng.randrange(60), rng.randrange(60)) for _ in range(5000)]
    yield "chain", [(i, i + 1) for i in range(3000)][::-1]
    yield "hubs", [(h, rng.randrange(10, 4000)) for h in range(3) for _ in range(1500)]
    yield "none", []


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
@pytest.mark.parametrize("small", [0, 100_000])
def test_components_after_contraction(spark, name, edges, small):
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    found = graph.connected_components(df, small=small)
    assert {r["node"]: r["component"] for r in found.collect()} == labels(edges)


def test_tasks_send_no_more_edges_than_nodes(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(20_000)]
    df = spark.createDataFrame(edges, "u long, v long").coalesce(4)
    sent = graph.spanning_edges(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert all(r["count"] < 200 for r in sent)
    monkeypatch.setattr(graph, "HELD_EDGES", 50)  # a full task begins anew: more edges, the same components
    assert labels([tuple(r) for r in graph.spanning_edges(df).collect()]) == labels(edges)


def test_region_pairs_by_bands(spark):
    """Far fewer pairs than all of a patch, and none that is alike is left out: also at turned lines and borders of bands."""
    rng = random.Random(2)
    step = math.pi / clusters.ANGLES
    rows, stars = [], []
    for roi in range(400):
        patch, theta = roi % 2, rng.choice([rng.uniform(-math.pi, math.pi), rng.randrange(-18, 19) * step, 0.0, -1e-17, math.pi - 1e-9, -math.pi])
        rows.append((patch, roi, 0, roi % 2, roi % 7, roi, theta, rng.uniform(-1, 1), 9.0, roi))
        x, y = rng.choice([rng.uniform(-20, 20), 5.0, -5.0, 0.0]), rng.uniform(-20, 20)
        stars += [(patch, roi, 0, k, x, y, 0.0, 0.0) for k in range(3)]
    rois = spark.createDataFrame(rows, "patch_id int, p int, q int, axis int, i int, j int, theta double, rho double, sigma double, roi long")
    held = spark.createDataFrame(stars, "patch_id int, p int, q int, ordinal int, mu_phi double, mu_lam double, rv double, distance double")
    found = {tuple(r) for r in clusters.roi_edges(rois, held, CFG).collect()}
    full = rois.join(held.where("ordinal = 0").select("patch_id", "p", "q", "mu_phi", "mu_lam"), ["patch_id", "p", "q"])
    a, b = full.alias("a"), full.alias("b")
    c = F.col
    alike = lines_compatible(c("a.theta"), c("a.rho"), c("b.theta"), c("b.rho"), CFG.theta_merge, CFG.rho_merge)
    near = F.sqrt(F.pow(c("a.mu_phi") - c("b.mu_phi"), 2) + F.pow(c("a.mu_lam") - c("b.mu_lam"), 2)) < CFG.pm_compat
    other = (c("a.axis") != c("b.axis")) | (c("a.i") != c("b.i"))
    want = a.join(b, (c("a.patch_id") == c("b.patch_id")) & (c("a.roi") < c("b.roi")) & alike & near & other).select("a.roi", "b.roi")
    assert found == {tuple(r) for r in want.collect()} and found
    assert clusters.roi_pairs(rois, held, CFG).count() < 0.2 * 2 * 200 * 199 / 2


def test_drawn_pairs_differ_and_agree():
    a, b = lines.drawn_pairs("1-5-2-3", 7, 300)
    assert (a != b).all() and set(a) == set(b) == set(range(7))
    assert (a == lines.drawn_pairs("1-5-2-3", 7, 300)[0]).all() and (a != lines.drawn_pairs("1-5-2-4", 7, 300)[0]).any()
