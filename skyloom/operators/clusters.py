"""From regions of interest to ranked candidates (J9 to J12, G2 to G4, A8 to A11, FL13 to FL17, W1, W5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.functions.angles import dist_valid, galactic, lines_compatible, rv_valid
from skyloom.operators.graph import connected_components
from skyloom.session import staged


def first_stats(members: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Means, and sums of valid distances and radial velocities, over each group's first rows."""
    d, v = F.when(dist_valid(), F.col("distance")), F.when(rv_valid(), F.col("rv"))
    if order != "ordinal":
        members = members.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return members.where(F.col("ordinal") < most).groupBy(*keys).agg(
        F.avg("mu_phi").alias("m_phi"), F.avg("mu_lam").alias("m_lam"), F.avg(d).alias("m_dist"),
        F.count(v).alias("n_rv"), F.sum(v).alias("s_rv"), F.sum(v * v).alias("s2_rv"),
    )


def _gates(a: str, b: str, cfg: DetectConfig, dist_limit: float, dist_share: float, rv_limit: float) -> Column:
    """Distance and radial-velocity gates of a pair, where asked and where both sides have valid values."""
    ok = F.lit(True)
    c = lambda side, name: F.col(f"{side}.{name}")
    if cfg.use_distance:
        gap = F.abs(c(a, "m_dist") - c(b, "m_dist"))
        far = (gap > dist_limit) & (gap / ((c(a, "m_dist") + c(b, "m_dist")) / 2) > dist_share)
        ok = ok & ~F.coalesce(far, F.lit(False))
    if cfg.use_rv:
        n, s, s2 = (c(a, x) + c(b, x) for x in ("n_rv", "s_rv", "s2_rv"))
        apart = F.abs(c(a, "s_rv") / c(a, "n_rv") - c(b, "s_rv") / c(b, "n_rv")) > rv_limit
        loose = (n > 2) & (F.sqrt(F.greatest(s2 - s * s / n, F.lit(0.0)) / (n - 1)) > cfg.max_rv_dispersion)
        ok = ok & ~F.coalesce(apart | loose, F.lit(False))
    return ok


#: Bins of line angle, as half a turn is the same line: a bin is no narrower than theta_merge.
ANGLES = 18


def roi_pairs(rois: DataFrame, cell_stars: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Pairs a, b (structs) of a patch's regions that may be alike: near in mean motion and in line angle.

    Regions lie in a grid of pm_compat in mean motion and of bins of angle; the
    second one is repeated for the bins around its own, and pairs meet by
    equality on the grid, each once.
    """
    stats = first_stats(cell_stars, ["patch_id", "p", "q"], "ordinal", 10)
    full = rois.join(stats, ["patch_id", "p", "q"]).select("patch_id", "roi", "axis", "i", "theta", "rho", "m_phi", "m_lam", "m_dist", "n_rv", "s_rv", "s2_rv")
    wide = max(math.pi / ANGLES, cfg.theta_merge * (1 + 1e-9))
    bins = max(1, int(math.pi / wide))  # whole bins: the last one is wider
    angle = F.least(F.floor(F.pmod(F.col("theta"), F.lit(math.pi)) / wide), F.lit(bins - 1)).cast("int")
    placed = full.select(F.struct(*full.columns).alias("r"), "patch_id", F.floor(F.col("m_phi") / cfg.pm_compat).alias("x"), F.floor(F.col("m_lam") / cfg.pm_compat).alias("y"), angle.alias("t"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    turns = F.explode(F.array_distinct(F.array(*[F.pmod(F.col("t") + k, F.lit(bins)) for k in (-1, 0, 1)]))).alias("t")
    near = placed.select(F.col("r").alias("b"), "patch_id", around("x"), "y", "t").select("b", "patch_id", "x", around("y"), "t").select("b", "patch_id", "x", "y", turns)
    return placed.withColumnRenamed("r", "a").join(near, ["patch_id", "x", "y", "t"]).where("a.roi < b.roi").select("a", "b")


def roi_edges(rois: DataFrame, cell_stars: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Pairs of a patch's regions from different signal regions with like motion and like lines."""
    apart = (F.col("a.axis") != F.col("b.axis")) | (F.col("a.i") != F.col("b.i"))
    motion = F.sqrt(F.pow(F.col("a.m_phi") - F.col("b.m_phi"), 2) + F.pow(F.col("a.m_lam") - F.col("b.m_lam"), 2)) < cfg.pm_compat
    lines = lines_compatible(F.col("a.theta"), F.col("a.rho"), F.col("b.theta"), F.col("b.rho"), cfg.theta_merge, cfg.rho_merge)
    # fixed values: 15 kpc or 15 percent, 10 km/s
    joined = roi_pairs(rois, cell_stars, cfg).where(apart & motion & lines & _gates("a", "b", cfg, 15.0, 0.15, 10.0))
    return joined.select(F.col("a.roi").alias("src"), F.col("b.roi").alias("dst"))


def _labelled(nodes: DataFrame, node: str, edges: DataFrame, label: str) -> DataFrame:
    """Nodes with the smallest node of their component; a node without edges is its own."""
    found = connected_components(edges).select(F.col("node").alias(node), F.col("component").alias(label))
    return nodes.join(found, node, "left").withColumn(label, F.coalesce(label, node))


def _turned(named: DataFrame) -> DataFrame:
    """Lines of a cluster turned to the side of its strongest one: (theta, rho) and (theta + pi, -rho) are one line."""
    lead = F.max_by("theta", F.struct("sigma", -F.col("roi"))).over(Window.partitionBy("cluster"))
    apart = F.col("theta") - lead
    turns = F.round(apart / math.pi)
    return named.withColumns({"theta": F.col("theta") - turns * math.pi, "rho": F.when(F.pmod(turns, F.lit(2.0)) == 1, -F.col("rho")).otherwise(F.col("rho"))})


def _first_rows(df: DataFrame, key: str, order: list[Column], most: int | None) -> DataFrame:
    """The first rows of each key, or all where there is no cap."""
    if most is None:
        return df
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def protoclusters(rois: DataFrame, cell_stars: DataFrame, cfg: DetectConfig, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, their regions and their stars.

    A cluster is a component of compatible regions, named by its first region.
    Angle and offset are means weighted by significance, without wrapping unless
    cfg.wrap_safe; its stars are the distinct selected stars of its cells, the
    first cluster_star_cap of them where that is set.
    """
    edges = roi_edges(rois, cell_stars, cfg) if edges is None else edges
    named = staged(_labelled(rois, "roi", edges, "cluster"), "named")
    if cfg.wrap_safe:
        named = _turned(named)
    w = F.col("sigma")
    lines = named.groupBy("patch_id", "cluster").agg(
        F.count("*").alias("n_rois"), F.sqrt(F.sum(w * w)).alias("significance"),
        (F.sum(w * F.col("theta")) / F.sum(w)).alias("theta"), (F.sum(w * F.col("rho")) / F.sum(w)).alias("rho"),
    )
    strong = lines.where(F.col("significance") >= cfg.significance_cut)
    regions = named.join(strong.select("cluster"), "cluster", "left_semi")
    first = regions.groupBy("patch_id", "p", "q", "cluster").agg(F.min("roi").alias("first_roi"))
    stars = cell_stars.join(first, ["patch_id", "p", "q"]).groupBy("patch_id", "cluster", "star_id").agg(
        F.min(F.struct("first_roi", "ordinal")).alias("seen"),
        *[F.first(c).alias(c) for c in ("ra", "dec", "pmra", "pmdec", "rv", "distance", "phi", "lam", "mu_phi", "mu_lam", "dist_from_center")],
    )
    stars = staged(_first_rows(stars, "cluster", [F.col("seen"), F.col("star_id")], cfg.cluster_star_cap), "cluster_stars")
    motion = stars.groupBy("cluster").agg(
        F.count("*").alias("n_line_stars"), F.avg("mu_phi").alias("mean_mu_phi"), F.avg("mu_lam").alias("mean_mu_lam"),
        F.stddev_pop("mu_phi").alias("std_mu_phi"), F.stddev_pop("mu_lam").alias("std_mu_lam"),
    )
    clusters = strong.join(motion, "cluster").withColumn("is_edge", F.abs("rho") > cfg.edge_rho)
    return clusters, regions, stars


def star_overlap(stars: DataFrame, same_patch: bool) -> DataFrame:
    """Shared stars of pairs of clusters, as a share of the stars of the first (the earlier one).

    ``stars`` has patch_id, cluster, star_id; pairs are within a patch or
    between patches. A cluster's name grows with its patch, so the smaller name
    is the earlier cluster. A star lies in few clusters, so the join on stars is
    sparse where a table of all pairs would not be.
    """
    size = stars.groupBy("cluster").agg(F.countDistinct("star_id").alias("size"))
    own = stars.select("star_id", "patch_id", "cluster").distinct()
    other = own.select("star_id", F.col("patch_id").alias("patch_2"), F.col("cluster").alias("cluster_2"))
    side = F.col("patch_id") == F.col("patch_2") if same_patch else F.col("patch_id") < F.col("patch_2")
    pairs = own.join(other, "star_id").where(side & (F.col("cluster") < F.col("cluster_2")))
    shared = pairs.groupBy("cluster", "cluster_2").agg(F.count("*").alias("shared"))
    return shared.join(size, "cluster").select("cluster", "cluster_2", "shared", (F.col("shared") / F.col("size")).alias("overlap"))


def position_overlap(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The share of rows of ``a`` with a row of ``b`` within ``tolerance`` in ra and dec, by cells of that size."""
    place = lambda c: F.floor(F.col(c) / tolerance)
    own = a.select(F.monotonically_increasing_id().alias("id"), "ra", "dec").withColumns({"x": place("ra"), "y": place("dec")})
    near = lambda c: F.explode(F.array(*[F.floor(F.col(c) / tolerance) + k for k in (-1, 0, 1)]))
    other = b.select(F.col("ra").alias("ra2"), F.col("dec").alias("dec2")).withColumn("x", near("ra2")).withColumn("y", near("dec2"))
    hit = (F.abs(F.col("ra") - F.col("ra2")) < tolerance) & (F.abs(F.col("dec") - F.col("dec2")) < tolerance)
    matched = own.join(other, ["x", "y"], "left").groupBy("id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    return matched.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("overlap"))


def protostreams(clusters: DataFrame, stars: DataFrame, cfg: DetectConfig) -> tuple[DataFrame, DataFrame]:
    """Groups of a patch's clusters that share more than duplicate_overlap of their stars, and the bridge to clusters."""
    same = star_overlap(stars, True).where(F.col("overlap") > cfg.duplicate_overlap)
    bridge = _labelled(clusters, "cluster", same.select(F.col("cluster").alias("src"), F.col("cluster_2").alias("dst")), "protostream")
    streams = bridge.groupBy("patch_id", "protostream").agg(
        F.max("significance").alias("significance"), F.max("is_edge").alias("is_edge"), F.count("*").alias("n_clusters")
    )
    streams = streams.where(F.col("significance") >= cfg.significance_cut)
    return streams, bridge.select("cluster", "protostream", "theta", "rho").join(streams.select("protostream"), "protostream", "left_semi")


def merge_edges(bridge: DataFrame, stars: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Protostreams of different patches of which a pair of clusters shares stars, line and, where asked, distance and velocity."""
    shared = star_overlap(stars, False).where(F.col("overlap") > cfg.merge_overlap)
    stats = first_stats(stars, ["cluster"], "seen", 20)
    full = bridge.join(stats, "cluster")
    a, b = full.alias("a"), full.alias("b")
    lines = lines_compatible(F.col("a.theta"), F.col("a.rho"), F.col("b.theta"), F.col("b.rho"), cfg.theta_merge, cfg.rho_merge)
    joined = shared.alias("s").join(a, F.col("s.cluster") == F.col("a.cluster")).join(b, F.col("s.cluster_2") == F.col("b.cluster"))
    # fixed values: 20 kpc or 20 percent, 15 km/s
    return joined.where(lines & _gates("a", "b", cfg, 20.0, 0.2, 15.0)).select(F.col("a.protostream").alias("src"), F.col("b.protostream").alias("dst")).distinct()


def candidates(streams: DataFrame, bridge: DataFrame, stars: DataFrame, cfg: DetectConfig) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates and their member stars (a star of two patches is a member twice).

    Candidates of one edge protostream drop out, as do those with too few or
    too many stars or, with radial velocities, too wide a spread of them. They
    are ranked in one task: candidates are a few for each patch at most.
    """
    merged = _labelled(streams, "protostream", merge_edges(bridge, stars, cfg), "candidate")
    groups = merged.groupBy("candidate").agg(F.count("*").alias("n_protostreams"), F.sqrt(F.sum(F.col("significance") * F.col("significance"))).alias("significance"), F.max("is_edge").alias("is_edge"))
    groups = groups.where(~((F.col("n_protostreams") == 1) & F.col("is_edge"))).drop("is_edge")
    held = _first_rows(merged.select("protostream", "candidate"), "candidate", [F.col("protostream")], cfg.protostream_cap)
    names = bridge.join(held, "protostream").join(groups.select("candidate"), "candidate", "left_semi")
    kept = [c for c in stars.columns if c not in ("cluster", "seen", "patch_id", "star_id")]
    members = stars.join(names.select("cluster", "candidate"), "cluster").groupBy("candidate", "patch_id", "star_id").agg(*[F.first(c).alias(c) for c in kept])
    members = _first_rows(members, "candidate", [F.col("patch_id"), F.col("star_id")], cfg.candidate_star_cap)
    v = F.when(rv_valid(), F.col("rv"))
    summary = members.groupBy("candidate").agg(
        F.count("*").alias("n_stars"), *[F.avg(c).alias(f"mean_{c}") for c in ("ra", "dec", "pmra", "pmdec")],
        F.count(v).alias("n_rv"), F.stddev_pop(v).alias("rv_spread"),
    )
    fine = F.col("n_stars").between(cfg.min_candidate_stars, cfg.max_candidate_stars)
    if cfg.use_rv:
        fine = fine & ~((F.col("n_rv") > 5) & (F.col("rv_spread") > cfg.max_rv_dispersion))
    l, b = galactic("mean_ra", "mean_dec")
    full = groups.join(summary.where(fine), "candidate").withColumns({"mean_l": l, "mean_b": b}).drop("n_rv", "rv_spread")
    ranked = full.withColumn("candidate_id", F.row_number().over(Window.orderBy(F.desc("significance"), "candidate")))
    return ranked, members.join(ranked.select("candidate", "candidate_id", "significance"), "candidate")
