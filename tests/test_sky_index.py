"""Catalogues in the order of the sky: cuts and patches read less and find the same."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.operators import cuts, patches
from skyloom.sources import sky_index

CFG = DetectConfig()


@pytest.fixture(scope="module")
def sky(spark, tmp_path_factory):
    """Stars over the whole sky, poles and odd positions too, as they come and in the order of the sky."""
    path = str(tmp_path_factory.mktemp("sky"))
    rand = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40)) / (1 << 40)
    stars = spark.range(400_000).select(F.col("id").alias("star_id"), (rand(1) * 360).alias("ra"), F.degrees(F.asin(2 * rand(2) - 1)).alias("dec"), rand(3).alias("pmra"), rand(4).alias("pmdec"))
    odd = [(-1, 0.0, 90.0), (-2, 360.0, -90.0), (-3, None, 1.0), (-4, float("nan"), 1.0), (-5, 10.0, None), (-6, 0.0, 0.0), (-7, 360.0, 0.0), (-8, 359.9999999, 0.0)]
    stars = stars.unionByName(spark.createDataFrame([(*r, 0.1, 0.1) for r in odd], stars.schema))
    sky_index.write_sky_catalogue(stars, path, files=6, group_bytes=64 << 10)
    return stars, path


def rows_read(df):
    """Rows that the scans of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getName():
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        found = leaves.apply(i).metrics().get("numOutputRows")
        total += found.get().value() if found.isDefined() and "FileSourceScan" in leaves.apply(i).getClass().getName() else 0
    return total


@pytest.mark.parametrize("box", [(10, 40, -5, 12), (350, 8, -3, 3), (0, 360, 80, 90), (0, 360, -90, -70), (359.5, 360, -1, 1), (100, 100.001, 20, 20.001)])
def test_boxes(spark, sky, box):
    stars, path = sky
    cfg = replace(CFG, ra_min=float(box[0]), ra_max=float(box[1]), dec_min=float(box[2]), dec_max=float(box[3]))
    found = cuts.sky_cuts(sky_index.read_sky_catalogue(spark, path, sky_index.box_ranges(cfg)), cfg)
    want = cuts.sky_cuts(stars, cfg)
    assert sorted(r["star_id"] for r in found.collect()) == sorted(r["star_id"] for r in want.collect())
    assert rows_read(found) < 400_000 / 3


def test_patches_read_their_zones(spark, sky):
    stars, path = sky
    some = [(0, 180.0, 50.0, 0.0, 0.0), (1, 0.4, 20.0, 0.0, 0.0), (2, 200.0, 89.5, 0.0, 0.0), (3, 359.9, -88.0, 0.0, 0.0)]
    grid = patches.patches_frame(spark, some)
    near = sky_index.read_sky_catalogue(spark, path, sky_index.patch_ranges([(p[1], p[2]) for p in some], CFG.patch_radius))
    found = patches.assign_patches(near, grid, CFG.patch_radius).select("star_id", "patch_id")
    want = patches.assign_patches(stars, grid, CFG.patch_radius).select("star_id", "patch_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert len({r["patch_id"] for r in want.collect()}) == 4
    assert rows_read(near) < 400_000 / 4


def test_all_stars_come_back(spark, sky):
    stars, path = sky
    back = sky_index.read_sky_catalogue(spark, path)
    assert back.columns == stars.columns and back.count() == stars.count()
    assert back.where("ra is null or isnan(ra)").count() == 2
    assert sky_index.read_sky_catalogue(spark, path, []).count() == 0


def test_ranges_hold_discs():
    """Random points of random discs lie in the ranges, also after many ranges were made few."""
    rng = random.Random(3)
    for _ in range(40):
        centres = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(rng.choice([1, 5, 200]))]
        ranges = sky_index.patch_ranges(centres, 2.0)
        assert len(ranges) <= sky_index.MAX_RANGES and ranges == sorted(ranges)
        for ra, dec in centres[:20]:
            away, turn, d0 = math.radians(2.0 * math.sqrt(rng.random())), rng.uniform(0, 2 * math.pi), math.radians(dec)
            d = math.asin(math.sin(d0) * math.cos(away) + math.cos(d0) * math.sin(away) * math.cos(turn))
            a = math.radians(ra) + math.atan2(math.sin(turn) * math.sin(away) * math.cos(d0), math.cos(away) - math.sin(d0) * math.sin(d))
            cell = int((math.degrees(d) + 90) / sky_index.ZONE) * sky_index.PARTS + min(int(math.degrees(a) % 360 / 360 * sky_index.PARTS), sky_index.PARTS - 1)
            assert any(low <= cell <= high for low, high in ranges)
