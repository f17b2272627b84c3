"""Scalar expressions and statistics against known values."""

import math

import numpy as np
import pytest
from skyloom.functions import angles, stats

GD1 = [-150.2, -148.9, -151.5, -149.8, -152.1, -150.6]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_galactic_poles_and_centre(spark):
    _, b = one(spark, *angles.galactic(192.85948, 27.12825))
    assert b == pytest.approx(90, abs=1e-6)
    l, b = one(spark, *angles.galactic(266.405, -28.936))
    assert abs((l + 180) % 360 - 180) < 0.1 and abs(b) < 0.1


@pytest.mark.parametrize("ra,dec", [(0, 0), (180, 45), (270, -30), (45, 89), (200, -89), (359.999, 0)])
def test_round_trip(spark, ra, dec):
    l, b = one(spark, *angles.galactic(float(ra), float(dec)))
    back = one(spark, *angles.equatorial(l, b))
    assert abs((back[0] - ra + 180) % 360 - 180) * math.cos(math.radians(dec)) < 1e-4
    assert back[1] == pytest.approx(dec, abs=1e-4)


@pytest.mark.parametrize("a,b,want", [((0, 90), (0, -90), 180), ((359, 0), (1, 0), 2), ((0, 0), (90, 0), 90), ((10, 20), (10, 20), 0)])
def test_separation(spark, a, b, want):
    args = [float(x) for x in (*a, *b)]
    assert one(spark, angles.separation(*args))[0] == pytest.approx(want, abs=1e-9)
    assert one(spark, angles.separation_acos(*args))[0] == pytest.approx(want, abs=1e-5)


def test_patch_frame(spark):
    phi, lam, away = one(spark, *angles.gnomonic(180.0, 50.0, 180.0, 50.0))
    assert (phi, lam, away) == (0, 0, 0)
    m = one(spark, *angles.patch_motion(180.0, 50.0, 3.0, -4.0, 180.0, 50.0))
    assert tuple(m) == (3.0, -4.0)
    m = one(spark, *angles.patch_motion(181.0, 50.5, 3.0, -4.0, 180.0, 50.0))
    assert math.hypot(*m) == pytest.approx(5)


def test_angles_clip_lerp(spark):
    row = one(spark, angles.normalize_360(-30.0), angles.normalize_180(190.0), angles.clip(5.0, 0.0, 1.0), angles.lerp(0.0, 10.0, 0.3))
    assert tuple(row) == (330.0, -170.0, 1.0, 3.0)
    assert math.isnan(one(spark, angles.clip(float("nan"), 0.0, 1.0))[0])
    assert tuple(one(spark, angles.is_finite(float("inf")), angles.is_finite(1.0), angles.is_nan(float("nan")))) == (False, True, True)


def test_lines_compatible(spark):
    f = lambda *v: one(spark, angles.lines_compatible(*map(float, v), 0.17, 0.5))[0]
    assert f(0.1, 1, 0.2, 1.2)
    assert not f(0.1, 1, 0.4, 1)
    assert not f(0.1, 1, 0.1, 1.6)
    assert f(0.1, 1, 0.1 - math.pi, -1.1)  # the same line, turned by half a circle
    assert not f(0.1, 1, 0.1 - math.pi, 1.1)
    assert one(spark, angles.line_distance(1.0, 1.0, 0.0, 0.25))[0] == pytest.approx(0.75)


def test_stream_frame_origin(spark):
    ra, dec = one(spark, *angles.stream_frame(180.0, 50.0, 0.0, 0.0))
    assert (ra, dec) == (pytest.approx(180), pytest.approx(50))


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 6, 8, 10)], "x double")
    assert df.agg(stats.variance0("x")).first()[0] == 10
    assert df.agg(stats.median0("x"), stats.mean0("x")).first()[:] == (6, 6)
    q = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert q.agg(stats.percentile0("x", 25), stats.percentile0("x", -5), stats.percentile0("x", 200)).first()[:] == (1.75, 1, 10)
    empty = q.where("x > 99").agg(stats.mean0("x"), stats.variance0("x"), stats.std0("x"), stats.median0("x"))
    assert empty.first()[:] == (0, 0, 0, 0)


def test_rv_dispersion_skips_invalid(spark):
    df = spark.createDataFrame([(v,) for v in [*GD1, 0.0, 1500.0]], "rv double")
    assert df.agg(stats.rv_dispersion()).first()[0] == pytest.approx(np.std(GD1, ddof=1))


def test_magnitudes(spark):
    df = spark.createDataFrame([(1.0, 4.0), (0.0, 1.0), (None, None)], "f double, i double")
    rows = df.select(angles.flux_magnitude("f"), angles.flux_magnitude_error("f", "i")).collect()
    assert rows[0][0] == 22.5 and rows[0][1] == pytest.approx(2.5 / math.log(10) / 2)
    assert rows[1][0] is None and rows[2][0] is None
    d = spark.createDataFrame([(0.5,), (0.01,), (-1.0,)], "p double").select(angles.parallax_distance("p"))
    assert [r[0] for r in d.collect()] == [2, 100, 100]
