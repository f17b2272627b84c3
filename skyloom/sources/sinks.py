"""Outputs of a detection run (SNK1 to SNK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.sources.named_csv import write_named_csv

# fixed values: printed formats and the name of a new candidate
CANDIDATE_NAME = "VM3-NEW"
CANDIDATE_FORMATS = {
    "significance": "%.2f", "n_protostreams": "%d", "n_stars": "%d", "mean_ra": "%.6f", "mean_dec": "%.6f",
    "mean_l": "%.6f", "mean_b": "%.6f", "mean_pmra": "%.3f", "mean_pmdec": "%.3f",
}
MEMBER_FORMATS = {
    "ra": "%.8f", "dec": "%.8f", "pmra": "%.4f", "pmdec": "%.4f", "rv": "%.2f", "distance": "%.4f", "g_mag": "%.3f", "bp_rp": "%.3f",
    "teff": "%.1f", "teff_err": "%.1f", "logg": "%.3f", "logg_err": "%.3f", "feh": "%.3f", "feh_err": "%.3f", "vsini": "%.2f",
    "anomaly_score": "%.6f", "stream_significance": "%.2f", "dist_from_center": "%.6f", "phi": "%.6f", "lambda": "%.6f",
    "mu_phi": "%.4f", "mu_lambda": "%.4f", "target_id": "%d",
}


def candidate_rows(candidates: DataFrame, name: str = CANDIDATE_NAME) -> DataFrame:
    """Printable rows of candidates with positive significance, in rank order."""
    fields = [F.format_string(p, F.col(c)).alias(c) for c, p in CANDIDATE_FORMATS.items()]
    return candidates.where("significance > 0").orderBy("candidate_id").select(F.col("candidate_id").cast("string").alias("candidate_id"), F.lit(name).alias("name"), *fields)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """One CSV file with a header, also where there is no candidate."""
    candidate_rows(candidates).coalesce(1).write.mode("overwrite").csv(path, header=True)


def member_rows(members: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """The 23 printable columns of member stars; columns that neither table has are 0."""
    if stars is not None:
        extra = [c for c in stars.columns if c not in members.columns]
        members = members.join(stars.select("star_id", *extra), "star_id", "left")
    named = members.withColumnsRenamed({"lam": "lambda", "mu_lam": "mu_lambda", "significance": "stream_significance"})
    have = set(named.columns)
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) if c in have else F.lit(0)
    fields = [F.format_string(p, value(c).cast("long" if p == "%d" else "double")).alias(c) for c, p in MEMBER_FORMATS.items()]
    return named.select(F.col("candidate_id").alias("candidate_rank"), *fields)


def write_members(members: DataFrame, path: str, stars: DataFrame | None = None, top: int = 20) -> None:
    """A folder of CSV files for each of the first ``top`` candidates."""
    member_rows(members.where(F.col("candidate_id") <= top), stars).write.mode("overwrite").partitionBy("candidate_rank").csv(path, header=True)


def write_named_files(candidates: DataFrame, members: DataFrame, path: str, stars: DataFrame | None = None, top: int = 20) -> None:
    """``stream_candidates.csv`` and ``stream_NNN_stars.csv`` of the first ``top`` candidates, written by tasks."""
    write_named_csv(candidate_rows(candidates), path, F.lit("stream_candidates.csv"), [F.col("candidate_id").cast("long")], always=["stream_candidates.csv"])
    own = member_rows(members.where(F.col("candidate_id") <= top), stars)
    name, order = F.format_string("stream_%03d_stars.csv", F.col("candidate_rank")), [F.col(c).cast("double") for c in ("ra", "dec", "phi")]
    write_named_csv(own, path, name, order, own.columns[1:], replaces=["stream_[0-9][0-9][0-9]_stars.csv"])


def write_summary(summary: DataFrame, path: str) -> None:
    four = ("center_ra", "center_dec", "center_l", "center_b")
    rows = summary.orderBy("patch_id").select("patch_id", *[F.format_string("%.4f", F.col(c)).alias(c) for c in four], "n_stars", F.col("is_valid").cast("int").alias("is_valid"))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def report(candidates: DataFrame, top: int = 10) -> DataFrame:
    """The best candidates, for printing."""
    return candidates.orderBy("candidate_id").limit(top).select("candidate_id", "significance", "n_stars", "mean_ra", "mean_dec", "mean_pmra", "mean_pmdec")
