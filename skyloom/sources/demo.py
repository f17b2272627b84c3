"""A star catalogue derived from an events table by hashes, with a planted stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.operators.patches import patch_grid, patches_frame

BOX = (176.0, 184.0, 46.0, 54.0)


def uniform(k: int):
    digits = F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(f"-{k}")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def demo_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars of an events table."""
    return stars_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stars_of_events(events: DataFrame) -> DataFrame:
    """star_id, ra, dec, pmra, pmdec, rv, distance; every twentieth star belongs to the planted stream."""
    u = {k: F.col(f"u{k}") for k in range(1, 9)}
    drawn = events.select("event_id", *[uniform(k).alias(f"u{k}") for k in u])
    member = F.col("event_id") % 20 == 0
    pick = lambda a, b: F.when(member, a).otherwise(b)
    ra = 176 + 8 * u[1]
    stars = drawn.select(
        F.col("event_id").alias("star_id"), ra.alias("ra"), pick(50 + 0.35 * (ra - 180) + 0.05 * (u[2] - 0.5), 46 + 8 * u[2]).alias("dec"),
        pick(-1.5 + 0.2 * (u[3] - 0.5), 3 * (u[3] + u[5] - 1)).alias("pmra"), pick(0.8 + 0.2 * (u[4] - 0.5), 3 * (u[4] + u[6] - 1)).alias("pmdec"),
        F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(pick(-150 + 20 * (u[7] - 0.5), 200 * (u[7] - 0.5))).alias("rv"),
        F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(pick(10 + 2 * (u[8] - 0.5), 100 * u[8])).alias("distance"),
    )
    return stars


def near_patches(cfg: DetectConfig | None = None) -> list[tuple[int, float, float, float, float]]:
    """Patches of the default grid that can reach the catalogue's box."""
    cfg = cfg or DetectConfig()
    a, b, c, d = BOX
    r = cfg.patch_radius + 0.01
    wide = r / 0.5
    return [p for p in patch_grid(cfg) if a - wide <= p[1] <= b + wide and c - r <= p[2] <= d + r]


def demo_patches(spark: SparkSession, cfg: DetectConfig | None = None) -> DataFrame:
    return patches_frame(spark, near_patches(cfg))
