"""Row cuts of a catalogue (FL1 to FL5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.config import DetectConfig


def ra_cut(df: DataFrame, low: float, high: float) -> DataFrame:
    """RA within [low, high], or outside (high, low) where the box wraps."""
    ra = F.col("ra")
    return df.where(ra.between(low, high) if low <= high else (ra >= low) | (ra <= high)).where(~F.isnan(ra))


def dec_cut(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("dec").between(low, high))


def distance_cut(df: DataFrame, low: float, high: float) -> DataFrame:
    """Positive distances must lie within [low, high]; others pass."""
    d = F.col("distance")
    return df.where(~(d > 0) | F.isnan(d) | d.between(low, high))


def sky_cuts(df: DataFrame, cfg: DetectConfig) -> DataFrame:
    """The cuts whose bounds differ from the defaults; ordinals stay as they are."""
    if cfg.ra_min > 0 or cfg.ra_max < 360:
        df = ra_cut(df, cfg.ra_min, cfg.ra_max)
    if cfg.dec_min > -90 or cfg.dec_max < 90:
        df = dec_cut(df, cfg.dec_min, cfg.dec_max)
    if cfg.dist_min > 0 or cfg.dist_max < 999:
        df = distance_cut(df, cfg.dist_min, cfg.dist_max)
    return df
