"""Sky patches: grids of centres and the assignment of stars to them (GR1, GR2, J1, J2, FL6 to FL8)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.functions.angles import L_NCP, NGP_DEC, NGP_RA, gnomonic, patch_motion, separation

#: Grids never have more patches, so the broadcast of a patch table has a bound (a fixed value).
MAX_PATCHES = 5000
PATCH_SCHEMA = "patch_id int, center_ra double, center_dec double, center_l double, center_b double"


def _galactic(ra: float, dec: float) -> tuple[float, float]:
    a, d, p = math.radians(ra - NGP_RA), math.radians(dec), math.radians(NGP_DEC)
    b = math.asin(math.sin(p) * math.sin(d) + math.cos(p) * math.cos(d) * math.cos(a))
    turn = math.atan2(math.cos(d) * math.sin(a), math.cos(p) * math.sin(d) - math.sin(p) * math.cos(d) * math.cos(a))
    return (L_NCP - math.degrees(turn) + 360.0) % 360.0, math.degrees(b)


def _separation(ra1: float, dec1: float, ra2: float, dec2: float) -> float:
    d1, d2 = math.radians(dec1), math.radians(dec2)
    a = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(math.radians(ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)))


# fixed values: the grid's own pi, spacing in radii (default and dense), declination limits and least cosines
GRID_PI = 3.14159265
DEFAULT_STEP, DENSE_STEP = 1.5, 0.8
DEFAULT_DECS = (-80.0, 80.0)
DEFAULT_COS, DENSE_COS = 0.1, 0.01


def _steps(begin: float, end: float, step: float, inclusive: bool = True):
    """Values by repeated addition, as a loop counter of doubles takes them."""
    x = begin
    while x < end or (inclusive and x == end):
        yield x
        x += step


def _grid(radius: float, min_b: float, spacing: float, decs: tuple[float, float], closed: bool, floor: float, half_turn: float, cap: int | None):
    out: list[tuple[int, float, float, float, float]] = []
    for dec in _steps(*decs, spacing, closed):
        across = spacing / max(math.cos(dec * half_turn / 180.0), floor)
        for ra in _steps(0.0, 360.0, across, False):
            l, b = _galactic(ra, dec)
            # fixed values: the two large satellite galaxies
            if abs(b) < min_b or _separation(ra, dec, 80.0, -69.0) < 10.0 or _separation(ra, dec, 13.0, -73.0) < 5.0:
                continue
            if cap is not None and len(out) >= cap:
                return out
            out.append((len(out), ra, dec, l, b))
    return out


def patch_grid(cfg: DetectConfig) -> list[tuple[int, float, float, float, float]]:
    """(patch_id, ra, dec, l, b) of the default grid: rows 1.5 radii apart from dec -80 to 80, MAX_PATCHES at most."""
    return _grid(cfg.patch_radius, cfg.min_galactic_b, DEFAULT_STEP * cfg.patch_radius, DEFAULT_DECS, True, DEFAULT_COS, GRID_PI, MAX_PATCHES)


def dense_patch_grid(cfg: DetectConfig) -> list[tuple[int, float, float, float, float]]:
    """The denser grid, 0.8 radii apart, without a cap."""
    s = DENSE_STEP * cfg.patch_radius
    return _grid(cfg.patch_radius, cfg.min_galactic_b, s, (-90.0 + s, 90.0), False, DENSE_COS, math.pi, None)


def patches_frame(spark: SparkSession, grid: list[tuple[int, float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame(grid, PATCH_SCHEMA)


def assign_patches(stars: DataFrame, patches: DataFrame, radius: float) -> DataFrame:
    """Each star with each patch whose centre is within ``radius``, in patch coordinates.

    Patches are repeated for the declination bands (of one radius) that they
    touch and broadcast, so the join is an equality on the band with the exact
    distance as residual; no star is shuffled. Stars with a null or NaN
    position meet no patch.
    """
    bands = F.sequence(F.floor((F.col("center_dec") - radius) / radius), F.floor((F.col("center_dec") + radius) / radius))
    sides = patches.select("patch_id", "center_ra", "center_dec", F.explode(bands).alias("_band"))
    near = stars.withColumn("_band", F.floor(F.col("dec") / radius)).join(F.broadcast(sides), "_band")
    near = near.where(separation("ra", "dec", "center_ra", "center_dec") <= radius).drop("_band")
    phi, lam, away = gnomonic("ra", "dec", "center_ra", "center_dec")
    m_phi, m_lam = patch_motion("ra", "dec", "pmra", "pmdec", "center_ra", "center_dec")
    near = near.withColumns({"phi": phi, "lam": lam, "mu_phi": m_phi, "mu_lam": m_lam})
    return near.withColumn("dist_from_center", F.sqrt(F.col("phi") * F.col("phi") + F.col("lam") * F.col("lam"))).drop("center_ra", "center_dec")


def patch_counts(star_patch: DataFrame) -> DataFrame:
    return star_patch.groupBy("patch_id").agg(F.count("*").alias("n_stars"))


def gate_patches(star_patch: DataFrame, least: int) -> DataFrame:
    """Rows of patches with ``least`` stars or more.

    The table of counts has a row for each patch (MAX_PATCHES at most for the
    default grid) and is broadcast: a shuffle by patch would put all stars of a
    patch into one task, there and in all steps that follow.
    """
    full = patch_counts(star_patch).where(F.col("n_stars") >= least).select("patch_id")
    return star_patch.join(F.broadcast(full), "patch_id", "left_semi")


def fiducial_cut(star_patch: DataFrame, radius: float) -> DataFrame:
    return star_patch.where(F.col("dist_from_center") <= radius)


def patch_summary(patches: DataFrame, star_patch: DataFrame) -> DataFrame:
    """Every patch with its number of stars."""
    counted = patches.join(patch_counts(star_patch), "patch_id", "left")
    return counted.withColumn("n_stars", F.coalesce("n_stars", F.lit(0))).withColumn("is_valid", F.lit(True))
