"""Aggregates with the conventions of small samples: 0 where a sample is too small."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import rv_valid


def mean0(x: str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance0(x: str) -> Column:
    """Sample variance; 0 for fewer than two values."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def std0(x: str) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def median0(x: str) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def percentile0(x: str, p: float) -> Column:
    """Percentile by linear interpolation; at and beyond the ends, least and greatest value."""
    return F.coalesce(F.percentile(x, F.lit(min(max(p, 0.0), 100.0) / 100.0)), F.lit(0.0))


def rv_dispersion(rv: str = "rv") -> Column:
    """Sample standard deviation over valid radial velocities; 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(F.when(rv_valid(rv), F.col(rv))), F.lit(0.0))
