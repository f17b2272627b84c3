"""The detection pipeline: catalogue to ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.operators.clusters import candidates, protoclusters, protostreams
from skyloom.operators.cuts import sky_cuts
from skyloom.operators.density import last_scores, score
from skyloom.operators.hough import cell_lines, roi_table
from skyloom.operators.patches import assign_patches, gate_patches, patch_grid, patches_frame
from skyloom.operators.windows import cells, gate_srs, sr_counts
from skyloom.session import staged


@dataclass
class Detection:
    """The tables of a run."""

    patches: DataFrame
    star_patch: DataFrame
    cell_stars: DataFrame
    rois: DataFrame
    clusters: DataFrame
    cluster_stars: DataFrame
    streams: DataFrame
    candidates: DataFrame
    members: DataFrame
    scores: DataFrame | None


def project(stars: DataFrame, cfg: DetectConfig, patches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Patches, and the stars of patches that are full enough."""
    patches = patches_frame(stars.sparkSession, patch_grid(cfg)) if patches is None else patches
    near = staged(assign_patches(sky_cuts(stars, cfg), patches, cfg.patch_radius), "star_patch")  # the gate and all further steps read it
    return patches, gate_patches(near, cfg.min_stars_patch)


def find_rois(star_patch: DataFrame, cfg: DetectConfig) -> tuple[DataFrame, DataFrame]:
    """Selected stars of all cells, and the significant regions of interest."""
    held = staged(cells(star_patch, cfg), "cells")  # lines and, later, members read it
    return held, roi_table(star_patch, cell_lines(held, cfg), cfg)


def detect(stars: DataFrame, cfg: DetectConfig | None = None, scorer: str | None = "knn", patches: DataFrame | None = None) -> Detection:
    """Run all steps. ``stars`` needs star_id, ra, dec, pmra, pmdec, rv and distance; scorer None leaves scores out.

    Scores never influence detection, so they are a branch of their own: only
    the member table reads them. Tables that several steps read are written to
    the shared folder once.
    """
    cfg = cfg or DetectConfig()
    patches, star_patch = project(stars, cfg, patches)
    held, rois = find_rois(star_patch, cfg)
    rois = staged(rois, "rois")
    # only cells that hold a region are needed from here
    held = held.join(rois.select("patch_id", "p", "q").distinct(), ["patch_id", "p", "q"], "left_semi")
    clusters, _, cluster_stars = protoclusters(rois, held, cfg)
    clusters = staged(clusters, "clusters")
    streams, bridge = protostreams(clusters, cluster_stars, cfg)
    streams, bridge = staged(streams, "streams"), staged(bridge, "bridge")
    ranked, members = candidates(streams, bridge, cluster_stars, cfg)
    scores = None
    if scorer:
        # regions are counted in patches that have members only
        wanted = staged(members.select("patch_id").distinct(), "wanted")
        inside = star_patch.join(wanted, "patch_id", "left_semi")
        scores = last_scores(score(inside, gate_srs(sr_counts(inside, cfg), cfg), cfg, scorer))
        members = members.join(scores.withColumnRenamed("score", "anomaly_score"), ["patch_id", "star_id"], "left").fillna(0.0, ["anomaly_score"])
    else:
        members = members.withColumn("anomaly_score", F.lit(0.0))
    return Detection(patches, star_patch, held, rois, clusters, cluster_stars, streams, ranked, members, scores)
