"""Operators on small catalogues against brute force, and the whole pipeline on planted streams."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.functions import angles
from skyloom.operators import clusters, density, knn, lines, patches, windows
from skyloom.operators.graph import connected_components
from skyloom.operators.ordinal import global_ordinal
from skyloom.plans.detect import detect
from skyloom.sources import catalog, coverage, fits, prep, sinks
from skyloom.sources.demo import stars_of_events

CFG = DetectConfig()


def naive_components(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, 3), (5, 4), (4, 5)]])
def test_components(spark, edges):
    for small in (0, 1000):  # in rounds, and in one task
        got = connected_components(spark.createDataFrame(edges, "src long, dst long"), small=small)
        assert {r["node"]: r["component"] for r in got.collect()} == naive_components([e for e in edges if e[0] != e[1]])


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 4)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), small=0)
    assert {r["node"]: r["component"] for r in got.collect()} == naive_components([e for e in edges if None not in e and e[0] != e[1]])


def test_global_ordinal(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "b", "c"]], "s string")
    got = global_ordinal(df, [F.col("s").asc_nulls_last()]).collect()
    assert [r["s"] for r in sorted(got, key=lambda r: r["ordinal"])] == ["a", "b", "b", "c", None]
    assert sorted(r["ordinal"] for r in got) == [0, 1, 2, 3, 4]
    assert global_ordinal(df.where("s = 'z'"), [F.col("s")]).count() == 0


def test_grids():
    assert len(patches.patch_grid(CFG)) == 3696
    assert len(patches.patch_grid(DetectConfig(patch_radius=15.0))) == 59
    assert len(patches.patch_grid(DetectConfig(patch_radius=1.5))) == patches.MAX_PATCHES
    assert len(patches.dense_patch_grid(CFG)) == 13250


def test_patch_join_equals_nested_loop(spark):
    rng = random.Random(1)
    stars = [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), 0.0, 0.0) for i in range(300)]
    stars += [(900, 0.0, 0.5, 0.0, 0.0), (901, 359.9, 0.5, 0.0, 0.0), (902, None, 1.0, 0.0, 0.0), (903, 10.0, float("nan"), 0.0, 0.0)]
    grid = [(0, 0.3, 0.4, 0.0, 0.0), (1, 359.8, 0.6, 0.0, 0.0), *((k, rng.uniform(0, 360), rng.uniform(-80, 80), 0.0, 0.0) for k in range(2, 12))]
    df = spark.createDataFrame(stars, "star_id long, ra double, dec double, pmra double, pmdec double")
    got = patches.assign_patches(df, patches.patches_frame(spark, grid), 9.0).select("star_id", "patch_id").collect()
    ok = [s for s in stars if s[1] is not None and not math.isnan(s[2])]
    want = {(s[0], p[0]) for s in ok for p in grid if patches._separation(s[1], s[2], p[1], p[2]) <= 9.0}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_band_join_is_a_hash_join(spark):
    df = spark.range(5).selectExpr("id as star_id", "1.0D*id as ra", "1.0D*id as dec", "0D as pmra", "0D as pmdec")
    plan = patches.assign_patches(df, patches.patches_frame(spark, [(0, 1.0, 1.0, 0.0, 0.0)]), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_windows_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-30.0, -30.1, -12.0, 0.3, 29.6, 29.75, float("nan"))] + [(None,)], "x double")
    got = [r[0] for r in df.select(windows.window_ids("x", CFG)).collect()]
    assert CFG.n_windows == 238
    assert got[0] == [0] and got[1] is None and got[2] == [71, 72] and got[3] == [120, 121] and got[4] == [237] and got[5:] == [None] * 3


def test_subsample_and_cap(spark):
    rows = [(1, i, 0.1, 0.1) for i in range(1203)]
    sp = spark.createDataFrame(rows, "patch_id int, star_id long, pmra double, pmdec double")
    got = windows.cells(sp, CFG).where("p = 120 and q = 120").orderBy("ordinal").collect()
    assert [r["star_id"] for r in got] == list(range(0, 1000, 2)) and got[0]["n"] == 1203
    rois = spark.createDataFrame([(1, i, a, j) for i in range(20) for a in (0, 1) for j in range(40)], "patch_id int, i int, axis int, j int")
    kept = windows.cap_rois(rois, CFG).collect()
    assert len(kept) == 1000 and {(r["i"], r["axis"], r["j"]) for r in kept} == set(itertools.islice(((i, a, j) for i in range(20) for a in (0, 1) for j in range(40)), 1000))


def test_cells_of_one_patch_meet_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(1, int(i), *map(float, rng.random(2))) for i in rng.permutation(3000) * 7] + [(2, 1, 0.1, 0.1), (1, None, 0.1, 0.1)]
    sp = spark.createDataFrame(rows, "patch_id int, star_id long, pmra double, pmdec double")
    wanted = sorted(windows.cells(sp, CFG).collect(), key=str)
    monkeypatch.setattr(windows, "TASK_ROWS", 500)
    dealt = windows.cells(patches.gate_patches(sp, 50), CFG)
    tasks = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 6  # the session's shuffles have 4 partitions
    assert sorted(dealt.collect(), key=str) == wanted
    for most in (100, 700):  # most cells are sliced, with steps of one and of more
        monkeypatch.setattr(windows, "SLICE_ROWS", most)
        assert sorted(windows.cells(sp, CFG).collect(), key=str) == wanted


def test_knn_brute_force(spark):
    rng = np.random.default_rng(2)
    pts, asks = rng.random((120, 3)).astype(np.float32), rng.random((25, 3)).astype(np.float32)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "point_id long, a double, b double, c double")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(asks)], "query_id long, a double, b double, c double")
    for scale in (None, [1.0, 1.0, 0.001]):
        got = knn.knn(p, q, 5, ["a", "b", "c"], scale=scale).collect()
        s = np.array(scale or [1, 1, 1], np.float32)
        for i, a in enumerate(asks):
            d = (((pts - a) * s) ** 2).sum(1)
            mine = [r["point_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
            assert np.allclose(np.sort(d)[:5], d[mine], rtol=1e-4) and len(mine) == 5
    few = knn.knn(p.where("point_id < 3"), q, 10, ["a", "b", "c"])
    assert few.count() == 75
    assert knn.nearest(p, q, ["a", "b", "c"]).count() == 25


def test_knn_line(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(10)], "point_id long, x double")
    q = spark.createDataFrame([(0, 5.0)], "query_id long, x double")
    assert sorted(r["point_id"] for r in knn.knn(p, q, 5, ["x"]).collect()) == [3, 4, 5, 6, 7]


def cloud(n, seed=0):
    """Points of very uneven density, with ties and a place that holds many."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.01, (n // 2, 3)), rng.random((n // 2, 3)) * 5, np.full((n // 10, 3), 0.25), np.round(rng.random((n // 10, 3)), 1)])
    return x.astype(np.float32)


def frame(spark, x, name, group=None):
    import pandas as pd

    df = pd.DataFrame({name: np.arange(len(x)), **{c: x[:, i] for i, c in enumerate("abc")}})
    if group is not None:
        df["g"] = group
    return spark.createDataFrame(df)


def brute(points, asks, k, scale=(1, 1, 1)):
    d = knn.squares(asks, points, list(scale))
    order = np.lexsort((np.broadcast_to(np.arange(len(points)), d.shape), d), axis=1)[:, :k]
    return {(q, r + 1): (int(p), float(d[q, p])) for q, own in enumerate(order) for r, p in enumerate(own)}


@pytest.mark.parametrize("scale", [None, [1.0, 0.0, 0.01]])
def test_knn_cells_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(knn, "CELL_POINTS", 64)
    monkeypatch.setattr(knn, "CELL_QUERIES", 50)
    points = cloud(2000)
    asks = np.concatenate([cloud(300, 1), [[99, 99, 99], [-50, 0, 0]]]).astype(np.float32)
    got = knn.knn_compared(frame(spark, points, "point_id"), frame(spark, asks, "query_id"), 7, ["a", "b", "c"], scale=scale).collect()
    want = brute(points, asks, 7, [s or 1.0 for s in scale or (1, 1, 1)])
    assert {(r["query_id"], r["rank"]): (r["point_id"], r["dist_sq"]) for r in got} == want
    assert np.median([r["compared"] for r in got]) < len(points) / 3


def test_knn_cells_in_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_POINTS", 100)
    points, asks = cloud(1500), cloud(200, 3)
    side, of = np.where(np.arange(len(points)) % 10 == 0, "small", "large"), np.where(np.arange(len(asks)) % 2 == 0, "small", "large")
    p, q = frame(spark, points, "point_id", side), frame(spark, asks, "query_id", of)
    lone = spark.createDataFrame([(9999, 0.1, 0.1, 0.1, None), (9998, None, 0.1, 0.1, "small"), (9997, float("nan"), 0.1, 0.1, "small")], "id long, a float, b float, c float, g string")
    p, q = p.unionByName(lone.withColumnRenamed("id", "point_id")), q.unionByName(lone.withColumnRenamed("id", "query_id"))
    got = {}
    for r in knn.knn(p, q, 3, ["a", "b", "c"], ["g"]).collect():
        got[r["g"], r["query_id"], r["rank"]] = r["point_id"]
    assert got.pop((None, 9999, 1)) == 9999
    for g in ("small", "large"):
        a, b = np.flatnonzero(side == g), np.flatnonzero(of == g)
        for (q_, rank), (p_, _) in brute(points[a], asks[b], 3).items():
            assert got.pop((g, int(b[q_]), rank)) == a[p_]
    assert not got


def test_knn_work_grows_with_the_points(spark):
    def compared(n):
        x = np.random.default_rng(n).random((n, 3)).astype(np.float32)
        p = frame(spark, x, "point_id")
        return knn.knn_compared(p, p.withColumnRenamed("point_id", "query_id"), 5, ["a", "b", "c"]).where("rank = 1").agg(F.sum("compared")).first()[0]

    small, large = compared(10_000), compared(80_000)
    assert math.log(large / small) / math.log(8) < 1.2


def test_knn_of_nothing(spark):
    p = frame(spark, cloud(50), "point_id")
    none = p.where("false")
    assert knn.knn(p, none.withColumnRenamed("point_id", "query_id"), 3, ["a", "b", "c"]).count() == 0
    assert knn.knn(none, p.withColumnRenamed("point_id", "query_id"), 3, ["a", "b", "c"]).count() == 0


def test_combine_and_ransac(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.5, 3.0), ("a", 2, 2.0, 1.0, 4.0), ("b", 1, 0.3, 0.1, -1.0), ("b", 2, 0.9, 0.2, 0.0)], "k string, o int, theta double, rho double, sigma double")
    got = {r["k"]: r for r in lines.combine_lines(df, ["k"], "o").collect()}
    assert got["a"]["theta"] == pytest.approx(11 / 7) and got["a"]["sigma"] == 5
    assert (got["b"]["theta"], got["b"]["rho"], got["b"]["sigma"]) == (0.3, 0.1, 0)
    rng = np.random.default_rng(0)
    pts = [(0, float(x), float(0.5 * x + 0.2)) for x in rng.random(40)] + [(0, *map(float, rng.random(2))) for _ in range(15)] + [(1, 0.0, 0.0)]
    fit = lines.ransac_lines(spark.createDataFrame(pts, "g int, phi double, lam double"), ["g"], 0.01, 60)
    assert [r["g"] for r in fit.collect()] == [0] and fit.first()["inliers"] >= 40


def test_two_patches_merge(spark):
    """A stream across two patches gives protoclusters in both, joined by the stars that they share."""
    rng = np.random.default_rng(4)
    rows = [(i, 178 + 4 * rng.random(), 0.0) for i in range(260)]
    rows = [(i, ra, 50 + 0.3 * (ra - 180) + 0.02 * rng.standard_normal(), -6 + 0.1 * rng.random(), 3 + 0.1 * rng.random(), -100.0 + rng.standard_normal(), 10.0) for i, ra, _ in rows]
    rows += [(1000 + i, 177 + 6 * rng.random(), 48 + 4 * rng.random(), float(rng.normal(0, 5)), float(rng.normal(0, 5)), 0.0, 0.0) for i in range(600)]
    stars = spark.createDataFrame([tuple(map(float, r)) for r in rows], "star_id double, ra double, dec double, pmra double, pmdec double, rv double, distance double").withColumn("star_id", F.col("star_id").cast("long"))
    grid = patches.patches_frame(spark, [(0, 179.4, 49.9, 0.0, 0.0), (1, 180.4, 50.1, 0.0, 0.0)])
    run = detect(stars, DetectConfig(use_rv=True, use_distance=True), "knn", grid)
    best = run.candidates.orderBy("candidate_id").first()
    assert best["n_protostreams"] >= 2 and best["mean_pmra"] == pytest.approx(-5.95, abs=0.2)
    mine = run.members.where("candidate_id = 1")
    assert mine.where("star_id < 1000").select("star_id").distinct().count() > 100
    assert mine.where("anomaly_score <> 0").count() > 0
    out = sinks.candidate_rows(run.candidates)
    assert out.columns[0] == "candidate_id" and out.first()["name"] == "VM3-NEW"
    assert len(sinks.member_rows(mine).columns) == 24


def test_empty_field_gives_no_candidates(spark):
    stars = stars_of_events(spark.range(4000).withColumnRenamed("id", "event_id"))
    run = detect(stars, DetectConfig(significance_cut=1e6), None, patches.patches_frame(spark, [(0, 180.0, 50.0, 0.0, 0.0)]))
    assert run.candidates.count() == 0 and run.members.count() == 0


def test_gates_on_velocity(spark):
    """Pairs with far velocities or a wide joint spread do not join where velocities are asked for."""
    cells = [(1, p, 0, k, 0.0, 0.0, v + k % 3, 10.0) for p, v in ((0, -150.0), (1, -148.0), (2, 80.0)) for k in range(6)]
    held = spark.createDataFrame(cells, "patch_id int, p int, q int, ordinal int, mu_phi double, mu_lam double, rv double, distance double")
    rois = spark.createDataFrame([(1, p, 0, 0, p, 0, 0.5, 0.1, 9.0, p) for p in range(3)], "patch_id int, p int, q int, axis int, i int, j int, theta double, rho double, sigma double, roi long")
    plain = {tuple(r) for r in clusters.roi_edges(rois, held, CFG).collect()}
    assert plain == {(0, 1), (0, 2), (1, 2)}
    assert {tuple(r) for r in clusters.roi_edges(rois, held, DetectConfig(use_rv=True)).collect()} == {(0, 1)}


def test_csv_catalogue(spark, tmp_path):
    path = tmp_path / "stars.csv"
    path.write_text('TARGET_RA,target_dec,PM_RA,pmdec,plx,extra\n10.5,20,1.5,-2,0.5,x\n360,1,nan,abc,0.01,y\n-1,5,0,0,0,z\n10,91,0,0,0,z\n"7.25",3,1e1,,,\n')
    got = catalog.read_catalog(spark, str(path)).orderBy("star_id").collect()
    assert [(r["ra"], r["dec"]) for r in got] == [(10.5, 20), (360, 1), (7.25, 3)]
    assert [r["distance"] for r in got] == [2, 100, 0] and got[0]["g_mag"] == 20 and got[0]["bp_rp"] == 0.75
    assert math.isnan(got[1]["pmra"]) and got[1]["pmdec"] == 0 and got[2]["pmra"] == 10
    with pytest.raises(ValueError):
        catalog.normalise(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(RuntimeError):
        catalog.read_catalog(spark, "x.fits", fits=False)


def test_csv_folder_in_file_order(spark, tmp_path):
    """star_id follows file names and places, whatever order Spark reads files and blocks in."""
    rng, want = random.Random(6), []
    for name, n in (("a", 3), ("b", 4000), ("c", 40)):
        rows = [(rng.uniform(0, 360), rng.uniform(-90, 90)) for _ in range(n)]
        (tmp_path / f"{name}.csv").write_text("ra,dec\n" + "".join(f"{a!r},{d!r}\n" for a, d in rows))
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = catalog.read_csv(spark, str(tmp_path)).select("star_id", "ra", "dec").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["ra"], r["dec"]) for r in sorted(got, key=lambda r: r["star_id"])] == want
    assert sorted(r["star_id"] for r in got) == list(range(len(want)))


def test_fits_round_trip(spark, tmp_path):
    n = 25
    columns = {"TARGET_RA": np.linspace(0, 350, n), "TARGET_DEC": np.linspace(-80, 80, n).astype("f4"), "TARGETID": np.arange(n) + 2**40, "KIND": np.array([b"STAR ", b"GAL"] * 12 + [b"STAR"]), "OK": np.arange(n) % 2 == 0}
    path = tmp_path / "t.fits"
    path.write_bytes(fits.fits_table(columns))
    got = fits.read_fits(spark, str(path)).orderBy("TARGETID").collect()
    assert [r["TARGET_RA"] for r in got] == columns["TARGET_RA"].tolist() and [r["KIND"] for r in got[:2]] == ["STAR", "GAL"]
    assert [r["OK"] for r in got] == columns["OK"].tolist() and got[3]["TARGETID"] == 2**40 + 3
    columns |= {"TARGET_DEC": np.where(np.arange(n) == 3, 95.0, 1.0), "PARALLAX": np.full(n, 0.5)}  # FITS rows keep odd positions and derive no distance
    path.write_bytes(fits.fits_table(columns))
    stars = catalog.read_catalog(spark, str(path))
    assert stars.where("distance <> 0").count() == 0 and stars.where("dec = 95").count() == 1
    assert stars.count() == n and stars.where("target_id > 0").count() == n


def test_preparation(spark):
    df = spark.createDataFrame([(0, " STAR ", 1.0, 2.0, 4.0, 1.0), (0, "GALAXY", 1.0, 1.0, 1.0, 1.0), (1, "STAR", 1.0, 1.0, 1.0, 1.0)], "rvs_warn int, rr_spectype string, flux_g double, flux_r double, flux_z double, flux_ivar_g double")
    df = df.withColumns({"flux_ivar_r": F.lit(1.0), "flux_ivar_z": F.lit(1.0)})
    got = prep.with_magnitudes(prep.good_stars(df)).collect()
    assert len(got) == 1 and got[0]["g_r"] == pytest.approx(2.5 * math.log10(2)) and got[0]["g_mag"] == 22.5
    m = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (None, 1.0)], "pmra double, pmdec double")
    assert prep.finite_motion(m).count() == 1
    spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 15.0, 16.0, 14.5, "STAR")], "ra double, dec double, pmra double, pmdec double, phot_g_mean_mag double, phot_bp_mean_mag double, phot_rp_mean_mag double, spectype string").createOrReplaceTempView("survey")
    assert prep.survey_stars(spark, "survey").first()["bp_rp"] == 1.5


def test_tile_coverage(spark):
    frame = spark.createDataFrame([(172.0, 11.0, 2), (173.0, 11.5, 1), (172.0, 14.0, 5)], "tile_ra double, tile_dec double, passes int")
    stars = spark.createDataFrame([(1, 172.4, 11.0), (2, 100.0, -50.0), (3, 172.0, 12.6)], "star_id int, ra double, dec double")
    cover = {r["star_id"]: r["coverage"] for r in coverage.tile_coverage(stars, frame, 1.6).collect()}
    assert cover == {1: 3, 2: 0, 3: 6}
    twice = coverage.tile_coverage(stars.unionByName(stars), frame, 1.6).collect()
    assert sorted((r["star_id"], r["coverage"]) for r in twice) == sorted([(k, v) for k, v in cover.items()] * 2)


def test_kth_squares_equal_all_pairs(monkeypatch):
    """The k-d tree gives the same float32 squares as comparing all, also for clumps and repeated points."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(density, "BRUTE", 10)
    for pts in (rng.random((3000, 3)), np.concatenate([rng.random((500, 3)) * 1e-3, rng.random((400, 3)), np.tile(rng.random(3), (300, 1))]), np.zeros((200, 2)), rng.random((700, 1))):
        pts = pts.astype(np.float32)
        for place in (1, 15):
            want = np.partition(knn.squares(pts, pts), place, axis=1)[:, place]
            assert (density.kth_squares(pts, place) == want).all()


def test_large_region_in_bounded_memory():
    """A region of the most stars that pass the gate, in far less than all pairs."""
    import tracemalloc

    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.random((50_000, 3)), 0.5 + 1e-3 * rng.standard_normal((50_000, 3))]).astype(np.float32)
    tracemalloc.start()
    found = density.kth_squares(pts, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for i in (0, 777, 60_000):
        assert found[i] == np.partition(knn.squares(pts[i : i + 1], pts)[0], 15)[15]


def test_kernel_density_equals_plain_sums():
    rng = np.random.default_rng(7)
    data, asks = rng.normal(0, 3, (400, 3)), rng.normal(0, 4, (60, 3))
    asks[0, 2] = 90.0  # far from all data
    for h in (np.array([2.0, 2.0, 0.2]), 0.7):
        width = np.broadcast_to(h, 3)
        want = [np.mean([np.prod(np.exp(-0.5 * ((a - d) / width) ** 2) / (width * np.sqrt(2 * np.pi))) for d in data]) for a in asks]
        assert np.allclose(density.kernel_density(asks, data, h), want, rtol=1e-8, atol=1e-290)
    h, one = density.kernel_bandwidths(data)
    assert len(h) == 3 and h[0] >= 2 and h[1] >= 2 and one == pytest.approx(np.prod(h) ** (1 / 3))


@pytest.mark.parametrize(("h", "dims"), [((2.0, 2.0, 0.3), 3), ((0.9, 1.1, 0.5), 3), ((2.0, 0.05), 2), ((0.4, 0.4, 4.0), 3)])
def test_fitted_kernels_equal_sums(monkeypatch, h, dims):
    """Polynomials on both sides give what all kernels give, also at borders, in gaps and far out."""
    rng = np.random.default_rng(len(h))
    sky = lambda n: rng.uniform(-1.78, 1.78, (n, dims - 1))
    data = np.column_stack([sky(6000), np.concatenate([rng.normal(0, 4, 4500), rng.normal(-2, 0.05, 1490), np.full(10, 3.0)])])
    asks = np.column_stack([sky(3000), rng.normal(0, 5, 3000)])
    asks[:4, -1], asks[4] = (60.0, -80.0, 3.0, 400.0), data[0]
    want = density._direct(asks / h, data / h) / len(data) / np.prod(np.sqrt(2 * np.pi) * np.array(h))
    pairs = []
    direct = density._direct
    monkeypatch.setattr(density, "_direct", lambda z, d: (pairs.append(len(z) * len(d)), direct(z, d))[1])
    monkeypatch.setattr(density, "FIT_PAIRS", 0)
    assert np.allclose(density.kernel_density(asks, data, h), want, rtol=1e-8, atol=1e-290)


def test_fitted_kernels_spare_pairs(monkeypatch):
    """Of 100,000 stars, fewer than a fifth of the pairs are looked at."""
    rng = np.random.default_rng(3)
    make = lambda n: np.column_stack([rng.uniform(-1.78, 1.78, (n, 2)), rng.normal(0, 5, n)])
    asks, data, pairs = make(5000), make(95_000), []
    direct = density._direct
    monkeypatch.setattr(density, "_direct", lambda z, d: (pairs.append(len(z) * len(d)), direct(z, d))[1])
    density.kernel_density(asks, data, density.kernel_bandwidths(data)[0])
    assert sum(pairs) < len(asks) * len(data) / 5


def test_regions_share_fits(monkeypatch):
    """Densities of all windows equal those of each by itself, and stars go to nodes once for all windows and once for each own."""
    rng = np.random.default_rng(11)
    n = 12_000
    x = np.column_stack([rng.uniform(-1.78, 1.78, (n, 2)), np.sort(rng.triangular(-3, 0, 3, n))])
    pm, starts = rng.triangular(-3, 0, 3, n), [-3.0 + 0.25 * i for i in range(23)]
    pm[:300], pm[300:305] = -2.9, np.nan  # narrow kernels at one end, and stars that are in no window
    fitted, weights = [], density._Boxes.weights
    monkeypatch.setattr(density._Boxes, "weights", lambda self, data: (fitted.append(len(data)), weights(self, data))[1])
    monkeypatch.setattr(density._Boxes, "worth", staticmethod(lambda axes, pairs: True))
    monkeypatch.setattr(density, "FIT_PAIRS", 100_000)
    found = density.region_densities(x, pm, starts, 0.5)
    assert n < sum(fitted) < 4 * n
    for (at, *got), start in zip(found, starts, strict=True):
        inside = (pm >= start) & (pm < start + 0.5)
        assert (at == np.flatnonzero(inside)).all()
        for dens, data in zip(got, (x[inside], x[~inside]), strict=True):
            h = density.kernel_bandwidths(data)[0]
            want = density._direct(x[inside] / h, data / h) / len(data) / np.prod(np.sqrt(2 * np.pi) * h)
            assert np.allclose(dens, want, rtol=1e-7, atol=1e-290)


def test_kernels_of_both_tails_spare_what_lies_between(monkeypatch):
    z, data = np.column_stack([np.zeros(40), np.repeat([-100.0, 100.0], 20)]), np.column_stack([np.zeros(5000), np.linspace(-60, 60, 5000)])
    pairs, direct = [], density._direct
    monkeypatch.setattr(density, "_direct", lambda a, b: (pairs.append(len(a) * len(b)), direct(a, b))[1])
    density._near(z, data)
    assert sum(pairs) == 0


def _kernel_rows(spark, n, dup=0):
    """A patch with a clump, stars far out and one that is alone, and its signal regions."""
    rng = np.random.default_rng(17)
    x = np.column_stack([rng.uniform(-1.78, 1.78, (n, 2)), rng.triangular(-4, 0, 4, n), rng.triangular(-4, 0, 4, n)])
    pm = rng.triangular(-1.5, 0, 1.5, (n, 2))
    x[: n // 10, 2], x[n // 10 : n // 10 + 3, 2], x[n // 10 + 3, 2] = rng.normal(1, 0.02, n // 10), (30.0, -25.0, 30.0), -60.0
    x[50:60, 2] = 0.0
    rows = [(3, i, *map(float, pm[i]), *map(float, x[i])) for i in range(n)]
    rows += rows[:dup]
    sp = spark.createDataFrame(rows, "patch_id int, star_id long, pmra double, pmdec double, phi double, lam double, mu_lam double, mu_phi double")
    return sp, windows.sr_counts(sp, CFG).where("n_sr >= 10"), np.array(rows)


def _kernel_score(rows, axis, i):
    """Star and score of a region by all pairs."""
    pm, x = rows[:, 2 + axis], rows[:, [4, 5, 6 + axis]]
    inside = (pm >= -30 + 0.25 * i) & (pm < -29.5 + 0.25 * i)
    dens = []
    for data in (x[inside], x[~inside]):
        h = density.kernel_bandwidths(data)[0]
        dens.append(density._direct(x[inside] / h, data / h) / len(data) / np.prod(h))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(dens[1] * (2 * np.pi) ** -1.5 > 1e-300, dens[0] / dens[1], 1e10)
    return dict(zip(rows[inside, 1].astype(int).tolist(), ratio.tolist(), strict=True))


@pytest.mark.parametrize("block", [200_000, 700])
def test_kernel_scores_in_blocks_equal_all_pairs(spark, monkeypatch, block):
    """A patch cut into blocks has the scores of all pairs, for rows that repeat a star too."""
    monkeypatch.setattr(density, "PATCH_STARS", block)
    monkeypatch.setattr(density, "BLOCK_STARS", block)
    monkeypatch.setattr(density, "BUCKET_ROWS", 20)
    sp, regions, rows = _kernel_rows(spark, 4000, dup=300)
    found = density.kde_scores(sp, regions, CFG).toPandas()
    want = {(axis, i): _kernel_score(rows, axis, i) for axis, i in found[["axis", "i"]].drop_duplicates().itertuples(index=False)}
    assert len(want) == regions.where("n_sb >= 100").count()
    assert len(found) == sum(map(len, want.values()))
    assert np.allclose(found.score, [want[a, i][s] for a, i, s in found[["axis", "i", "star_id"]].itertuples(index=False)], rtol=1e-7)


def test_blocks_of_large_patches_are_parts(spark, monkeypatch):
    """No block holds more than a part of a patch, each star is of one block, and bandwidths are those of the whole sides."""
    monkeypatch.setattr(density, "PATCH_STARS", 0)
    monkeypatch.setattr(density, "BLOCK_STARS", 1000)
    monkeypatch.setattr(density, "BLOCKS", 100)
    monkeypatch.setattr(density, "BUCKET_ROWS", 50)
    sp, regions, rows = _kernel_rows(spark, 20_000)
    seen = {}
    blocked = density._blocked
    monkeypatch.setattr(density, "_blocked", lambda *a: seen.setdefault("made", blocked(*a)))
    density.kde_scores(sp, regions, CFG)
    wide, stars = seen["made"][0].dropDuplicates(["axis", "i"]).toPandas(), seen["made"][1]
    size = stars.groupBy("axis", "block").agg(F.count("*").alias("n"), F.sum(F.col("mine").cast("int")).alias("own")).toPandas()
    assert size.n.max() < 0.8 * len(rows) and size.own.max() < 0.1 * len(rows)
    assert stars.where("mine").groupBy("axis", "star_id").count().where("count > 1").isEmpty()
    for r in wide.itertuples():
        pm, x = rows[:, 2 + r.axis], rows[:, [4, 5, 6 + r.axis]]
        inside = (pm >= -30 + 0.25 * r.i) & (pm < -29.5 + 0.25 * r.i)
        for side, data in enumerate((x[inside], x[~inside])):
            assert np.allclose([getattr(r, f"h{side}_{d}") for d in density.DIMS], density.kernel_bandwidths(data)[0], rtol=1e-12)


def test_kernel_score_drops_no_large_region(spark, monkeypatch):
    """The scan's upper bound of a signal region's stars does not hold for the kernel score."""
    from dataclasses import replace

    from skyloom import queries

    monkeypatch.setattr(queries, "CFG", replace(CFG, max_stars_sr=40))
    sp = queries.projected(spark, "/root/testdata/sf0.001")
    want = windows.sr_counts(sp, CFG).where("n_sr >= 10 and n_sb >= 100")
    assert want.agg(F.max("n_sr")).first()[0] > 40
    got = queries.q_kde_score(spark, "/root/testdata/sf0.001")
    assert got.count() == want.agg(F.sum("n_sr")).first()[0]


def test_scores_with_distance_and_velocity(spark):
    """Third axes of the neighbour score against plain loops; histogram scores against counting every star in every region."""
    rng = np.random.default_rng(8)
    n = 260
    rows = [(0, i, float(rng.uniform(-0.4, 0.4)), float(rng.uniform(-3, 3)), *map(float, rng.uniform(-1.7, 1.7, 2)), *map(float, rng.normal(0, 1, 2)), float(rng.choice([0.0, 50.0, -80.0])), float(rng.choice([0.0, 5.0, 20.0]))) for i in range(n)]
    sp = spark.createDataFrame(rows, "patch_id int, star_id long, pmra double, pmdec double, phi double, lam double, mu_phi double, mu_lam double, rv double, distance double")
    for use_d, use_v in ((True, False), (False, True), (True, True)):
        cfg = DetectConfig(use_distance=use_d, use_rv=use_v)
        good = windows.gate_srs(windows.sr_counts(sp, cfg), cfg)
        got = {(r["axis"], r["i"], r["star_id"]): r["score"] for r in density.knn_scores(sp, good, cfg).collect()}
        axis, i = 0, 119
        own = [r for r in rows if -30 + 0.25 * i <= r[2] < -29.5 + 0.25 * i]
        x = np.array([[r[4], r[5]] for r in own])
        x = (x - x.mean(axis=0)) / np.maximum(np.sqrt(x.var(axis=0)), 2.0)
        z = []
        for use, col, ok in ((use_d, 9, lambda v: (v > 0.1) & (v < 500)), (use_v, 8, lambda v: (abs(v) > 0.001) & (abs(v) < 1000))):
            v = np.array([r[col] for r in own])
            if use:
                z.append(np.where(ok(v), (v - v[ok(v)].mean()) / v[ok(v)].std(), 0.0))
        third = np.sqrt(z[0] ** 2 + z[1] ** 2) / np.sqrt(2) if len(z) == 2 else z[0]
        full = np.column_stack([x, third])
        d = np.sqrt(((full[:, None] - full[None]) ** 2).sum(axis=2))
        k = max(3, min(15, len(own) // 2))
        r = np.maximum(np.sort(d, axis=1)[:, min(k, len(own) - 1)], 0.01)
        want = (r.mean() - r) / np.sqrt(max((r * r).mean() - r.mean() ** 2, 1e-300))
        assert np.allclose([got[axis, i, o[1]] for o in own], want, atol=1e-3)
    cfg = CFG
    good = windows.gate_srs(windows.sr_counts(sp, cfg), cfg)
    hist = {(r["axis"], r["i"], r["star_id"]): r["score"] for r in density.histogram_scores(sp, good, cfg).collect()}
    assert {(a, i) for a, i, _ in hist} == {(r["axis"], r["i"]) for r in good.where("n_sb >= 100").collect()}
    for axis, i in sorted({(a, i) for a, i, _ in hist})[::5]:
        inside = [-30 + 0.25 * i <= r[2 + axis] < -29.5 + 0.25 * i for r in rows]
        x = np.array([[r[4], r[5], r[7 - axis]] for r in rows])
        side = x[~np.array(inside)]
        low, high = side.min(axis=0), side.max(axis=0)
        bins = np.clip(np.floor((x - (low - 0.1 * (high - low))) / (1.2 * (high - low) / 10)), 0, 9).astype(int)
        for k in np.flatnonzero(inside)[:7]:
            same = (bins == bins[k]).all(axis=1)
            a, b = (same & inside).sum(), (same & ~np.array(inside)).sum()
            want = ((a + 1) / (sum(inside) + 100_000)) / ((b + 1) / (n - sum(inside) + 100_000))
            assert hist[axis, i, k] == pytest.approx(want)


def test_caps_and_turned_lines(spark):
    cells = [(1, p, 0, p * 10 + k, k, 0.1, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for p in range(2) for k in range(8)]
    held = spark.createDataFrame(cells, "patch_id int, p int, q int, star_id long, ordinal int, ra double, dec double, pmra double, pmdec double, rv double, distance double, phi double, lam double, mu_phi double, mu_lam double, dist_from_center double")
    lines_ = [(0, 3.0, 0.4), (1, 3.0 - math.pi, -0.4)]
    rois = spark.createDataFrame([(1, p, 0, 0, p, 0, t, r, 9.0 - p, p) for p, t, r in lines_], "patch_id int, p int, q int, axis int, i int, j int, theta double, rho double, sigma double, roi long")
    plain, _, all_stars = clusters.protoclusters(rois, held, CFG)
    turned, _, few = clusters.protoclusters(rois, held, DetectConfig(wrap_safe=True, cluster_star_cap=5))
    assert plain.count() == 1 and abs(plain.first()["theta"] - 3.0) > 1
    assert turned.first()["theta"] == pytest.approx(3.0) and turned.first()["rho"] == pytest.approx(0.4)
    assert all_stars.count() == 16 and few.count() == 5 and {r["star_id"] for r in few.collect()} == set(range(5))


def test_command_line(spark, tmp_path, capsys):
    from skyloom.__main__ import main, parser

    rng = np.random.default_rng(4)
    rows = [(178 + 4 * rng.random(), -6 + 0.1 * rng.random(), 3 + 0.1 * rng.random()) for _ in range(260)]
    text = [f"{ra},{50 + 0.3 * (ra - 180) + 0.02 * rng.standard_normal()},{a},{d},-100,0.1" for ra, a, d in rows]
    text += [f"{177 + 6 * rng.random()},{48 + 4 * rng.random()},{rng.normal(0, 5)},{rng.normal(0, 5)},0,0.01" for _ in range(600)]
    (tmp_path / "in.csv").write_text("ra,dec,pmra,pmdec,rv,parallax\n" + "\n".join(text) + "\n")
    out = tmp_path / "out"
    assert main([str(tmp_path / "in.csv"), "-o", str(out), "--ra-min", "177", "--ra-max", "183", "-s", "7.5", "-k", "10"]) == 0
    found = (out / "stream_candidates.csv").read_text().splitlines()
    assert len(found) > 1 and found[0].startswith("candidate_id,name,significance")
    members = (out / "stream_001_stars.csv").read_text().splitlines()
    assert len(members[0].split(",")) == 23 and len(members) > 100
    scores = {line.split(",")[members[0].split(",").index("anomaly_score")] for line in members[1:]}
    assert len(scores) > 10 and list((out / "patches").glob("*.csv")) and "Candidates:" in capsys.readouterr().out
    assert main([str(tmp_path / "in.csv"), "-q", "--dec-min", "80"]) == 1
    a = parser().parse_args(["x.fits", "-H", "--use-rv", "--sky-bandwidth", "3", "-p", "2"])
    assert a.histogram and a.use_rv and (a.sky_bandwidth, a.patch_radius) == (3.0, 2.0)


def test_fits_vectors_nulls_and_stacks(spark, tmp_path):
    one, two = tmp_path / "one.fits", tmp_path / "two.fits"
    one.write_bytes(fits.fits_table({"TARGET_RA": np.arange(9.0), "TARGET_DEC": np.arange(9.0), "PMRA": np.where(np.arange(9) == 4, np.nan, 1.0), "PMDEC": np.ones(9), "FLUX_G": np.full(9, 10.0), "FLUX_IVAR_G": np.ones(9), "RVS_WARN": np.arange(9) % 2, "RR_SPECTYPE": np.array([b"STAR"] * 9)}))
    two.write_bytes(fits.fits_table({"DIST50": np.arange(9) * 2.0, "target_ra": np.zeros(9)}))
    rows = prep.stacked_hdus(spark, str(one), (2,), str(two)).collect()
    assert [(r["TARGET_RA"], r["DIST50"]) for r in sorted(rows, key=lambda r: r["TARGET_RA"])] == [(k, 2.0 * k) for k in range(9)]
    ready = prep.prepared_catalogue(spark, str(one), (2,), str(two)).collect()
    assert sorted((r["ra"], r["distance"]) for r in ready) == [(0, 0), (2, 4), (6, 12), (8, 16)] and ready[0]["g_mag"] == 20.0
    assert prep.convert_catalogue(spark, str(one), str(tmp_path / "csv")).count() == 8 and prep.convert_catalogue(spark, str(one), str(tmp_path / "csv"), limit=3).count() == 3
    # three numbers in a cell, and a null number
    body = np.array([1, 2, 3, 4, -9, 6], ">i4").tobytes()
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 12), ("NAXIS2", 2), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "'PAIR'"), ("TFORM1", "'2J'"), ("TTYPE2", "'ONE'"), ("TFORM2", "'J'"), ("TNULL2", 6)]
    head = "".join(f"{f'{k:<8}= {v}':<80}" for k, v in cards) + f"{'END':<80}"
    first = "".join(f"{f'{k:<8}= {v}':<80}" for k, v in (("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0))) + f"{'END':<80}"
    path = tmp_path / "v.fits"
    path.write_bytes(first.ljust(2880).encode() + head.ljust(2880).encode() + body.ljust(2880, b"\0"))
    got = fits.read_fits(spark, str(path)).collect()
    assert [(list(r["PAIR"]), r["ONE"]) for r in got] == [([1, 2], 3), ([4, -9], None)]


def test_position_overlap(spark):
    a = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0), (5.0, 6.0)], "ra double, dec double")
    b = spark.createDataFrame([(1.0 + 4e-7, 2.0), (5.0, 6.0 - 4e-7), (3.0, 4.1)], "ra double, dec double")
    assert clusters.position_overlap(a, b).first()[0] == 0.75


def test_tile_coverage_compares_borders_only(spark):
    """Poles, the turn of right ascension, angles beyond both, unknown places, and many tiles at one place."""
    rng = np.random.default_rng(8)
    tiles = [(float(a), float(d), int(k)) for a, d, k in zip(rng.uniform(-20, 20, 60), rng.uniform(-4, 4, 60), rng.integers(1, 4, 60), strict=True)]
    tiles += [(10.0, 89.5, 2), (200.0, -89.9, 3), (359.9, 91.0, 1), (float("nan"), 1.0, 7), (None, 1.0, 7), (0.5, 0.5, None)] + [(0.2, 0.1, 1)] * 300
    places = [*zip(rng.uniform(-21, 381, 1500), rng.uniform(-5, 5, 1500), strict=True), *zip(rng.uniform(0, 360, 300), rng.uniform(87, 93, 300), strict=True), *zip(rng.uniform(0, 360, 200), rng.uniform(-90, -87, 200), strict=True)]
    places = [(float(a), float(d)) for a, d in places] + [(0.0, 90.0), (360.0, 0.0), (float("nan"), 0.0), (0.0, None), (0.0, float("inf"))]
    stars = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "star_id int, ra double, dec double")
    got = {r["star_id"]: r["coverage"] for r in coverage.tile_coverage(stars, spark.createDataFrame(tiles, "tile_ra double, tile_dec double, passes int"), 1.6).collect()}
    known = np.radians(np.array([t[:2] for t in tiles if None not in t]))
    passes = np.array([t[2] for t in tiles if None not in t])
    for i, (a, d) in enumerate(places):
        if d is None or not np.isfinite([a, d]).all():
            assert got[i] == 0
            continue
        a, d = np.radians([a, d])
        h = np.sin((known[:, 1] - d) / 2) ** 2 + np.cos(known[:, 1]) * np.cos(d) * np.sin((known[:, 0] - a) / 2) ** 2
        assert got[i] == passes[2 * np.degrees(np.arctan2(np.sqrt(h), np.sqrt(1 - h))) <= 1.6].sum()
    assert sum(v >= 300 for v in got.values()) > 2
