"""Registered queries of the detection engine, one for each operator, with DuckDB SQL beside them.

All run over whole tables. Stars are derived from ``events`` by hashes that are
equal in both engines; floating-point results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import DetectConfig
from skyloom.functions import angles, stats
from skyloom.operators import clusters, cuts, density, hough, knn, lines, patches, selection, windows
from skyloom.plans.detect import detect, find_rois
from skyloom.session import shared_path, staged
from skyloom.sources import catalog, coverage, fits, prep, sinks, sky_index
from skyloom.sources.demo import demo_patches, demo_stars, near_patches

CFG = DetectConfig()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars in the patches that are full enough."""
    near = staged(patches.assign_patches(demo_stars(spark, sf_dir), demo_patches(spark), CFG.patch_radius), "star_patch")  # the gate and several steps read it
    return patches.gate_patches(near, CFG.min_stars_patch)


# ---- SQL pieces

D = "(pi()/180)"


def _u(k: int) -> str:
    return f"(cast(concat('0x', substr(md5(concat(cast(event_id as varchar), '-{k}')), 1, 8)) as bigint) / 4294967296.0)"


STARS = f"""drawn AS (SELECT event_id, {', '.join(f'{_u(k)} AS u{k}' for k in range(1, 9))} FROM events),
stars AS (SELECT event_id AS star_id, 176 + 8*u1 AS ra,
 CASE WHEN event_id % 20 = 0 THEN 50 + 0.35*((176 + 8*u1) - 180) + 0.05*(u2 - 0.5) ELSE 46 + 8*u2 END AS dec,
 CASE WHEN event_id % 20 = 0 THEN -1.5 + 0.2*(u3 - 0.5) ELSE 3*(u3 + u5 - 1) END AS pmra,
 CASE WHEN event_id % 20 = 0 THEN 0.8 + 0.2*(u4 - 0.5) ELSE 3*(u4 + u6 - 1) END AS pmdec,
 CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 20 = 0 THEN -150 + 20*(u7 - 0.5) ELSE 200*(u7 - 0.5) END AS rv,
 CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 20 = 0 THEN 10 + 2*(u8 - 0.5) ELSE 100*u8 END AS distance
 FROM drawn)"""


def sql_galactic(ra: str, dec: str) -> tuple[str, str]:
    a, d, p = f"(({ra})*{D} - {angles.NGP_RA}*{D})", f"(({dec})*{D})", f"({angles.NGP_DEC}*{D})"
    b = f"degrees(asin(sin({p})*sin({d}) + cos({p})*cos({d})*cos({a})))"
    turn = f"degrees(atan2(cos({d})*sin({a}), cos({p})*sin({d}) - sin({p})*cos({d})*cos({a})))"
    return f"fmod({angles.L_NCP} - {turn} + 360, 360)", b


def sql_sep(a1: str, d1: str, a2: str, d2: str) -> str:
    h = f"(pow(sin(({d2}-({d1}))*{D}/2),2) + cos(({d1})*{D})*cos(({d2})*{D})*pow(sin((({a2})*{D}-({a1})*{D})/2),2))"
    return f"degrees(2*atan2(sqrt({h}), sqrt(1-{h})))"


def _patch_values() -> str:
    rows = ", ".join(f"({p}, '{a!r}'::double, '{d!r}'::double, '{l!r}'::double, '{b!r}'::double)" for p, a, d, l, b in near_patches(CFG))
    return f"patches(patch_id, center_ra, center_dec, center_l, center_b) AS (VALUES {rows})"


_D, _D0, _DA = f"(dec*{D})", f"(center_dec*{D})", f"((ra-center_ra)*{D})"
_C = f"(sin({_D0})*sin({_D}) + cos({_D0})*cos({_D})*cos({_DA}))"
_PA = f"atan2(sin(-{_DA})*cos({_D0}), cos({_D})*sin({_D0}) - sin({_D})*cos({_D0})*cos({_DA}))"
SP = f"""{STARS}, {_patch_values()},
near AS (SELECT * FROM stars, patches WHERE {sql_sep('ra', 'dec', 'center_ra', 'center_dec')} <= {CFG.patch_radius}),
turned AS (SELECT *, degrees(atan(cos({_D})*sin({_DA})/{_C})) AS phi,
 degrees(atan((cos({_D0})*sin({_D}) - sin({_D0})*cos({_D})*cos({_DA}))/{_C})) AS lam, {_PA} AS pa FROM near),
sp_all AS (SELECT *, pmra*cos(pa) + pmdec*sin(pa) AS mu_phi, pmdec*cos(pa) - pmra*sin(pa) AS mu_lam, sqrt(phi*phi + lam*lam) AS dist_from_center FROM turned),
sp AS (SELECT * FROM sp_all WHERE patch_id IN (SELECT patch_id FROM sp_all GROUP BY patch_id HAVING count(*) >= {CFG.min_stars_patch}))"""
WIN = "win AS (SELECT unnest(range(0, 238)) AS k)"
SR = f"""{SP}, {WIN},
sr AS (SELECT patch_id, star_id, 0 AS axis, k AS i, phi, lam, mu_lam AS mu, rv, distance FROM sp JOIN win ON pmra >= -30 + 0.25*k AND pmra < -29.5 + 0.25*k
 UNION ALL SELECT patch_id, star_id, 1, k, phi, lam, mu_phi, rv, distance FROM sp JOIN win ON pmdec >= -30 + 0.25*k AND pmdec < -29.5 + 0.25*k),
psize AS (SELECT patch_id, count(*) AS n_patch FROM sp GROUP BY patch_id),
src AS (SELECT patch_id, axis, i, count(*) AS n_sr, any_value(n_patch) - count(*) AS n_sb FROM sr JOIN psize USING (patch_id) GROUP BY patch_id, axis, i),
good AS (SELECT * FROM src WHERE n_sr BETWEEN 10 AND 100000)"""


def _cells(cap: int) -> str:
    return f"""placed AS (SELECT sp.*, a.k AS p, b.k AS q, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY patch_id, a.k, b.k) AS n
 FROM sp JOIN win a ON pmra >= -30 + 0.25*a.k AND pmra < -29.5 + 0.25*a.k JOIN win b ON pmdec >= -30 + 0.25*b.k AND pmdec < -29.5 + 0.25*b.k
 WINDOW w AS (PARTITION BY patch_id, a.k, b.k ORDER BY star_id)),
cell AS (SELECT * EXCLUDE (rn), cast(rn // greatest(n // {cap}, 1) AS int) AS ordinal FROM placed
 WHERE n >= 5 AND rn % greatest(n // {cap}, 1) = 0 AND rn // greatest(n // {cap}, 1) < {cap})"""


CELLS = f"{SR}, {_cells(CFG.max_roi_stars)}"
_RM = CFG.rho_max
HOUGH = f"""{CELLS}, bin AS (SELECT unnest(range(0, 90)) AS t),
votes AS (SELECT patch_id, p, q, n, t, r, count(*) AS votes FROM (SELECT patch_id, p, q, n, t,
 cast(floor((phi*cos(-pi() + (t+0.5)*(2*pi()/90)) + lam*sin(-pi() + (t+0.5)*(2*pi()/90)) + {_RM!r}) / ({2 * _RM / 100!r})) AS int) AS r FROM cell, bin)
 WHERE r BETWEEN 0 AND 99 GROUP BY patch_id, p, q, n, t, r),
picked AS (SELECT patch_id, p, q, n, votes, t, r, row_number() OVER (PARTITION BY patch_id, p, q ORDER BY votes DESC, t, r) AS rn FROM votes),
sel AS (SELECT patch_id, p, q, count(*) AS n_selected FROM cell GROUP BY patch_id, p, q),
peak AS (SELECT patch_id, p, q, n, n_selected, votes, -pi() + (t+0.5)*(2*pi()/90) AS theta, -{_RM!r} + (r+0.5)*{2 * _RM / 100!r} AS rho
 FROM picked JOIN sel USING (patch_id, p, q) WHERE rn = 1),
base AS (SELECT *, (votes - greatest(1, n_selected/100))/greatest(1, sqrt(greatest(1, n_selected/100))) AS s FROM peak),
line AS (SELECT * EXCLUDE (s), CASE WHEN votes/n_selected > 0.5 THEN greatest(s, 8) WHEN votes/n_selected > 0.3 THEN greatest(s, 5) ELSE s END AS sigma FROM base)"""
ROI = f"""{HOUGH},
fan AS (SELECT *, 0 AS axis, p AS i, q AS j FROM line WHERE sigma >= 4 UNION ALL SELECT *, 1, q, p FROM line WHERE sigma >= 4),
capped AS (SELECT fan.*, row_number() OVER (PARTITION BY patch_id ORDER BY i, axis, j) AS rn FROM fan JOIN good USING (patch_id, axis, i)),
roi AS (SELECT * EXCLUDE (rn), ((cast(patch_id AS bigint)*238 + i)*2 + axis)*238 + j AS roi FROM capped WHERE rn <= {CFG.max_rois_per_patch})"""


def sql_compatible(a: str, b: str) -> str:
    g = f"abs({a}.theta - {b}.theta)"
    g = f"(CASE WHEN {g} > pi() THEN 2*pi() - {g} ELSE {g} END)"
    t = f"(abs({g} - pi()) < {CFG.theta_merge!r})"
    return (
        f"(CASE WHEN {t} THEN abs({g} - pi()) ELSE {g} END < {CFG.theta_merge!r} AND "
        f"abs({a}.rho - (CASE WHEN {t} THEN -{b}.rho ELSE {b}.rho END)) < {CFG.rho_merge})"
    )


def sql_components(name: str, edges: str, nodes: str, node: str) -> str:
    """label: the least node that reaches each node; only nodes without a smaller neighbour send their name."""
    return f"""{name}_both AS (SELECT src AS x, dst AS y FROM {edges} UNION SELECT dst, src FROM {edges}),
{name}_walk(x, seed) AS (SELECT {node}, {node} FROM {nodes} WHERE {node} NOT IN (SELECT x FROM {name}_both WHERE y < x)
 UNION SELECT b.y, w.seed FROM {name}_walk w JOIN {name}_both b ON b.x = w.x),
{name} AS (SELECT x AS {node}, min(seed) AS label FROM {name}_walk GROUP BY x)"""


EDGES = f"""{ROI},
ten AS (SELECT patch_id, p, q, avg(mu_phi) AS m_phi, avg(mu_lam) AS m_lam FROM cell WHERE ordinal < 10 GROUP BY patch_id, p, q),
full_roi AS (SELECT roi.*, m_phi, m_lam FROM roi JOIN ten USING (patch_id, p, q)),
edge AS (SELECT a.roi AS src, b.roi AS dst FROM full_roi a JOIN full_roi b ON a.patch_id = b.patch_id AND a.roi < b.roi AND (a.axis <> b.axis OR a.i <> b.i)
 AND sqrt(pow(a.m_phi-b.m_phi,2) + pow(a.m_lam-b.m_lam,2)) < 5 AND {sql_compatible('a', 'b')})"""
CLUSTERS = f"""{EDGES}, {sql_components('roi_cc', 'edge', 'roi', 'roi')},
named AS (SELECT roi.*, label AS cluster FROM roi JOIN roi_cc USING (roi)),
strong AS (SELECT patch_id, cluster, count(*) AS n_rois, sqrt(sum(sigma*sigma)) AS significance, sum(sigma*theta)/sum(sigma) AS theta, sum(sigma*rho)/sum(sigma) AS rho
 FROM named GROUP BY patch_id, cluster HAVING sqrt(sum(sigma*sigma)) >= 8),
cstar AS (SELECT DISTINCT patch_id, cluster, star_id, ra, dec, pmra, pmdec, rv, distance, mu_phi, mu_lam
 FROM cell JOIN (SELECT DISTINCT patch_id, p, q, cluster FROM named WHERE cluster IN (SELECT cluster FROM strong)) USING (patch_id, p, q)),
clu AS (SELECT strong.*, m.* EXCLUDE (cluster), abs(rho) > 1.5 AS is_edge FROM strong JOIN (SELECT cluster, count(*) AS n_line_stars, avg(mu_phi) AS mean_mu_phi,
 avg(mu_lam) AS mean_mu_lam, stddev_pop(mu_phi) AS std_mu_phi, stddev_pop(mu_lam) AS std_mu_lam FROM cstar GROUP BY cluster) m USING (cluster)),
csize AS (SELECT cluster, count(*) AS size FROM cstar GROUP BY cluster),
shared AS (SELECT a.patch_id AS patch_1, b.patch_id AS patch_2, a.cluster, b.cluster AS cluster_2, count(*) AS shared FROM cstar a JOIN cstar b ON a.star_id = b.star_id AND a.cluster < b.cluster GROUP BY ALL),
olap AS (SELECT shared.*, shared/size AS overlap FROM shared JOIN csize USING (cluster))"""
STREAMS = f"""{CLUSTERS},
same AS (SELECT cluster AS src, cluster_2 AS dst FROM olap WHERE patch_1 = patch_2 AND overlap > 0.4), {sql_components('ps_cc', 'same', 'clu', 'cluster')},
bridge_all AS (SELECT clu.*, label AS protostream FROM clu JOIN ps_cc USING (cluster)),
ps AS (SELECT patch_id, protostream, max(significance) AS significance, bool_or(is_edge) AS is_edge, count(*) AS n_clusters FROM bridge_all GROUP BY ALL HAVING max(significance) >= 8),
bridge AS (SELECT * FROM bridge_all WHERE protostream IN (SELECT protostream FROM ps)),
medge AS (SELECT DISTINCT a.protostream AS src, b.protostream AS dst FROM olap JOIN bridge a ON olap.cluster = a.cluster JOIN bridge b ON olap.cluster_2 = b.cluster
 WHERE patch_1 < patch_2 AND overlap > 0.2 AND {sql_compatible('a', 'b')})"""
_L, _B = sql_galactic("mean_ra", "mean_dec")
CANDIDATES = f"""{STREAMS}, {sql_components('cand_cc', 'medge', 'ps', 'protostream')},
merged AS (SELECT ps.*, label AS candidate FROM ps JOIN cand_cc USING (protostream)),
grp AS (SELECT candidate, count(*) AS n_protostreams, sqrt(sum(significance*significance)) AS significance FROM merged GROUP BY candidate HAVING NOT (count(*) = 1 AND bool_or(is_edge))),
member AS (SELECT DISTINCT candidate, cstar.patch_id, star_id, ra, dec, pmra, pmdec FROM cstar JOIN bridge USING (cluster) JOIN merged USING (protostream) WHERE candidate IN (SELECT candidate FROM grp)),
summ AS (SELECT candidate, count(*) AS n_stars, avg(ra) AS mean_ra, avg(dec) AS mean_dec, avg(pmra) AS mean_pmra, avg(pmdec) AS mean_pmdec FROM member GROUP BY candidate HAVING count(*) BETWEEN 10 AND 2000),
cand AS (SELECT *, {_L} AS mean_l, {_B} AS mean_b, row_number() OVER (ORDER BY significance DESC, candidate) AS candidate_id FROM grp JOIN summ USING (candidate))"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ---- cuts and projections


@register(f"WITH {STARS} SELECT star_id, {rounded('ra', 'dec')} FROM stars WHERE ra BETWEEN 177 AND 181 AND dec BETWEEN 48 AND 52")
def q_scan_cuts(spark, sf_dir):
    df = cuts.sky_cuts(demo_stars(spark, sf_dir), replace(CFG, ra_min=177, ra_max=181, dec_min=48, dec_max=52))
    return df.select("star_id", r6("ra"), r6("dec"))


@register(f"WITH {STARS} SELECT star_id, {rounded('ra')} FROM stars WHERE ra >= 183 OR ra <= 177")
def q_ra_wrap_cut(spark, sf_dir):
    return cuts.ra_cut(demo_stars(spark, sf_dir), 183.0, 177.0).select("star_id", r6("ra"))


@register(f"WITH {STARS} SELECT star_id, {rounded('distance')} FROM stars WHERE distance <= 0 OR distance BETWEEN 5 AND 60")
def q_distance_cut(spark, sf_dir):
    return cuts.distance_cut(demo_stars(spark, sf_dir), 5.0, 60.0).select("star_id", r6("distance"))


def _sky_catalogue(spark, sf_dir) -> str:
    path = shared_path(spark, "sky")
    sky_index.write_sky_catalogue(demo_stars(spark, sf_dir), path)
    return path


@register(f"WITH {STARS} SELECT star_id, {rounded('ra', 'dec')} FROM stars WHERE (ra >= 182.5 OR ra <= 176.75) AND dec BETWEEN 47.3 AND 53.1")
def q_sky_index_box(spark, sf_dir):
    """A box that wraps, cut from a catalogue in the order of the sky."""
    box = replace(CFG, ra_min=182.5, ra_max=176.75, dec_min=47.3, dec_max=53.1)
    stars = sky_index.read_sky_catalogue(spark, _sky_catalogue(spark, sf_dir), sky_index.box_ranges(box))
    return cuts.sky_cuts(stars, box).select("star_id", r6("ra"), r6("dec"))


_GL, _GB = sql_galactic("ra", "dec")


@register(f"WITH {STARS} SELECT star_id, round({_GL}, 6) AS l, round({_GB}, 6) AS b FROM stars")
def q_galactic(spark, sf_dir):
    l, b = angles.galactic("ra", "dec")
    return demo_stars(spark, sf_dir).select("star_id", r6(l, "l"), r6(b, "b"))


@register(f"WITH {STARS} SELECT star_id, {rounded('ra', 'dec')} FROM stars")
def q_equatorial_roundtrip(spark, sf_dir):
    l, b = angles.galactic("ra", "dec")
    ra, dec = angles.equatorial("l", "b")
    return demo_stars(spark, sf_dir).select("star_id", l.alias("l"), b.alias("b")).select("star_id", r6(ra, "ra"), r6(dec, "dec"))


@register(f"WITH {STARS} SELECT star_id, round({sql_sep('ra', 'dec', '180', '50')}, 6) AS sep, round({sql_sep('ra', 'dec', '180', '50')}, 6) AS sep_acos FROM stars")
def q_separation(spark, sf_dir):
    return demo_stars(spark, sf_dir).select("star_id", r6(angles.separation("ra", "dec", 180.0, 50.0), "sep"), r6(angles.separation_acos("ra", "dec", 180.0, 50.0), "sep_acos"))


@register(f"WITH {SP} SELECT star_id, patch_id, {rounded('phi', 'lam', 'dist_from_center')} FROM sp_all")
def q_gnomonic(spark, sf_dir):
    near = patches.assign_patches(demo_stars(spark, sf_dir), demo_patches(spark), CFG.patch_radius)
    return near.select("star_id", "patch_id", r6("phi"), r6("lam"), r6("dist_from_center"))


@register(f"WITH {SP} SELECT star_id, patch_id, {rounded('phi', 'lam')} FROM sp_all WHERE patch_id % 3 = 0")
def q_sky_index_patches(spark, sf_dir):
    """Every third patch, from the zones of a catalogue in the order of the sky that these patches meet."""
    some = [p for p in near_patches(CFG) if p[0] % 3 == 0]
    ranges = sky_index.patch_ranges([(p[1], p[2]) for p in some], CFG.patch_radius)
    stars = sky_index.read_sky_catalogue(spark, _sky_catalogue(spark, sf_dir), ranges)
    return patches.assign_patches(stars, patches.patches_frame(spark, some), CFG.patch_radius).select("star_id", "patch_id", r6("phi"), r6("lam"))


@register(f"WITH {SP} SELECT star_id, patch_id, {rounded('mu_phi', 'mu_lam')} FROM sp_all")
def q_pm_rotation(spark, sf_dir):
    near = patches.assign_patches(demo_stars(spark, sf_dir), demo_patches(spark), CFG.patch_radius)
    return near.select("star_id", "patch_id", r6("mu_phi"), r6("mu_lam"))


@register(f"""WITH {STARS}, a AS (SELECT star_id, (ra - 180)*200 AS x, pmra, pmdec FROM stars) SELECT star_id, round(x - 360*floor(x/360), 6) AS a360,
 round((x + 180) - 360*floor((x + 180)/360) - 180, 6) AS a180, round(greatest(-100, least(100, x)), 6) AS held, round(pmra + 0.25*(pmdec - pmra), 6) AS mid FROM a""")
def q_angle_norm(spark, sf_dir):
    df = demo_stars(spark, sf_dir).withColumn("x", (F.col("ra") - 180) * 200)
    return df.select("star_id", r6(angles.normalize_360("x"), "a360"), r6(angles.normalize_180("x"), "a180"), r6(angles.clip("x", -100.0, 100.0), "held"), r6(angles.lerp("pmra", "pmdec", 0.25), "mid"))


@register("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN l_discount > 0.01 THEN 1/l_discount ELSE 100 END, 6) AS by_parallax,
 round(CASE WHEN l_tax > 0 THEN 22.5 - 2.5*log10(l_tax) END, 6) AS mag, round(CASE WHEN l_tax > 0 AND l_quantity > 0 THEN 2.5/(ln(10)*l_tax*sqrt(l_quantity)) END, 6) AS mag_err FROM lineitem""")
def q_parallax_flux(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", r6(angles.parallax_distance("l_discount"), "by_parallax"),
        r6(angles.flux_magnitude("l_tax"), "mag"), r6(angles.flux_magnitude_error("l_tax", "l_quantity"), "mag_err"),
    )


@register(f"WITH {STARS} SELECT star_id, {rounded('ra', 'dec', 'pmra', 'pmdec')} FROM stars WHERE abs(pmra) < 2 AND abs(pmdec) < 2")
def q_alias_export(spark, sf_dir):
    df = demo_stars(spark, sf_dir).withColumnsRenamed({"ra": "TARGET_RA", "dec": "target_dec", "pmra": "GAIA_PMRA", "pmdec": "pm_dec"})
    names = {"star_id": ("star_id",), "ra": ("ra", "target_ra"), "dec": ("dec", "target_dec"), "pmra": ("pmra", "gaia_pmra"), "pmdec": ("pmdec", "pm_dec")}
    out = prep.export_rows(df, names, 2.0)
    return out.select("star_id", r6("ra"), r6("dec"), r6("pmra"), r6("pmdec"))


@register(f"WITH {STARS} SELECT star_id, {rounded('ra', 'dec', 'rv', 'distance')}, star_id % 3 = 0 AS picked, concat('HD ', star_id) AS name FROM stars WHERE dec > 50 AND distance <= 60 AND rv <> 0")
def q_fits_roundtrip(spark, sf_dir):
    """Stars as FITS files that tasks write, read back with comparisons pushed into the reader."""
    stars = demo_stars(spark, sf_dir).withColumns({"picked": F.col("star_id") % 3 == 0, "name": F.concat(F.lit("HD "), F.col("star_id"))})
    path = shared_path(spark, "fits")
    fits.write_fits(stars, path)
    back = fits.read_fits(spark, path).where("dec > 50 and distance <= 60 and rv <> 0")
    return back.select("star_id", r6("ra"), r6("dec"), r6("rv"), r6("distance"), "picked", "name")


@register(f"""WITH {STARS} SELECT row_number() OVER (ORDER BY star_id) - 1 AS star_id, {rounded('ra', 'dec', 'pmra', 'rv')}, 20.0::double AS g_mag, star_id AS target_id,
 CASE WHEN star_id % 11 = 0 THEN 0.0 ELSE round(CASE WHEN 1/distance > 0.01 THEN 1/(1/distance) ELSE 100 END, 6) END AS distance FROM stars""")
def q_csv_roundtrip(spark, sf_dir):
    """A catalogue as several CSV files with other headers: names, defaults, distances by parallax, and stars numbered in file order."""
    stars = demo_stars(spark, sf_dir).withColumn("plx", F.when(F.col("distance") > 0, 1 / F.col("distance")))
    named = stars.select(F.col("ra").alias("TARGET_RA"), F.col("dec").alias("Target_Dec"), F.col("pmra").alias("GAIA_PMRA"), "pmdec", F.col("rv").alias("VRAD"), "plx", F.col("star_id").alias("TARGETID"))
    path = shared_path(spark, "csv")
    named.repartitionByRange(3, "TARGETID").sortWithinPartitions("TARGETID").write.csv(path, header=True)
    back = catalog.read_csv(spark, path)
    return back.select("star_id", r6("ra"), r6("dec"), r6("pmra"), r6("rv"), "g_mag", "target_id", r6("distance"))


_P, _Q = f"(ra*{D})", f"((dec - 50)*{D})"


@register(f"""WITH {STARS}, v AS (SELECT star_id, cos({_Q})*cos({_P}) AS x, cos({_Q})*sin({_P}) AS y, sin({_Q}) AS z FROM stars),
t AS (SELECT star_id, degrees(atan2(y, x*cos(30*{D}) - z*sin(30*{D}))) + 34.5 AS a, degrees(asin(greatest(-1, least(1, x*sin(30*{D}) + z*cos(30*{D}))))) AS b FROM v)
SELECT star_id, round(a - 360*floor(a/360), 6) AS ra, round(b, 6) AS dec FROM t""")
def q_stream_frame(spark, sf_dir):
    """Right ascension and height over declination 50 taken as the two axes of a stream's frame."""
    ra, dec = angles.stream_frame(34.5, 30.0, F.col("ra"), F.col("dec") - 50)
    return demo_stars(spark, sf_dir).select("star_id", r6(ra, "ra"), r6(dec, "dec"))


# ---- patches and windows


_GRID_L, _GRID_B = sql_galactic("ra", "dec")
# the grid by recursion in SQL, in the order of rows and places; what reaches the catalogue's box is compared
GRID = f"""d(dec) AS (SELECT -80.0::double UNION ALL SELECT dec + {1.5 * CFG.patch_radius!r} FROM d WHERE dec + {1.5 * CFG.patch_radius!r} <= 80),
g(dec, ra, w) AS (SELECT dec, 0.0::double, {1.5 * CFG.patch_radius!r}/greatest(cos(dec*3.14159265/180.0), 0.1) FROM d UNION ALL SELECT dec, ra + w, w FROM g WHERE ra + w < 360),
kept AS (SELECT dec AS center_dec, ra AS center_ra, {_GRID_L} AS center_l, {_GRID_B} AS center_b FROM g
 WHERE abs({_GRID_B}) >= 20 AND {sql_sep('ra', 'dec', '80', '-69')} >= 10 AND {sql_sep('ra', 'dec', '13', '-73')} >= 5),
grid AS (SELECT cast(row_number() OVER (ORDER BY center_dec, center_ra) - 1 AS int) AS patch_id, * FROM kept)"""


@register(f"""WITH RECURSIVE {GRID} SELECT patch_id, {rounded('center_ra', 'center_dec', 'center_l', 'center_b')} FROM grid
WHERE center_ra BETWEEN 176 - {2 * (CFG.patch_radius + 0.01)} AND 184 + {2 * (CFG.patch_radius + 0.01)} AND center_dec BETWEEN 46 - {CFG.patch_radius + 0.01} AND 54 + {CFG.patch_radius + 0.01}""")
def q_patch_grid(spark, sf_dir):
    return demo_patches(spark).select("patch_id", r6("center_ra"), r6("center_dec"), r6("center_l"), r6("center_b"))


_DENSE = 0.8 * CFG.patch_radius
_DENSE_GRID = f"""d(dec) AS (SELECT {-90.0 + _DENSE!r}::double UNION ALL SELECT dec + {_DENSE!r} FROM d WHERE dec + {_DENSE!r} < {90.0 - _DENSE!r}),
g(dec, ra, w) AS (SELECT dec, 0.0::double, {_DENSE!r}/greatest(cos(dec*pi()/180.0), 0.01) FROM d UNION ALL SELECT dec, ra + w, w FROM g WHERE ra + w < 360),
kept AS (SELECT dec AS center_dec, ra AS center_ra FROM g WHERE abs({_GRID_B}) >= 20 AND {sql_sep('ra', 'dec', '80', '-69')} >= 10 AND {sql_sep('ra', 'dec', '13', '-73')} >= 5),
grid AS (SELECT cast(row_number() OVER (ORDER BY center_dec, center_ra) - 1 AS int) AS patch_id, * FROM kept)"""


@register(f"""WITH RECURSIVE {_DENSE_GRID}, {STARS}, close AS (SELECT * FROM grid WHERE center_dec BETWEEN 44 AND 56 AND center_ra BETWEEN 170 AND 190)
SELECT patch_id, round(center_ra, 6) AS center_ra, round(center_dec, 6) AS center_dec, count(*) AS n_stars FROM stars JOIN close ON {sql_sep('ra', 'dec', 'center_ra', 'center_dec')} <= {CFG.patch_radius} GROUP BY ALL""")
def q_dense_patch_counts(spark, sf_dir):
    """Stars in the patches of the denser grid that hold any."""
    grid = patches.patches_frame(spark, patches.dense_patch_grid(CFG))
    counts = patches.patch_counts(patches.assign_patches(demo_stars(spark, sf_dir), grid, CFG.patch_radius))
    return counts.join(grid, "patch_id").select("patch_id", r6("center_ra"), r6("center_dec"), "n_stars")


@register(f"WITH {SP} SELECT patch_id, center_ra, center_dec, coalesce(n, 0) AS n_stars, true AS is_valid FROM patches LEFT JOIN (SELECT patch_id, count(*) AS n FROM sp_all GROUP BY patch_id) USING (patch_id)")
def q_patch_summary(spark, sf_dir):
    known = demo_patches(spark)
    near = patches.assign_patches(demo_stars(spark, sf_dir), known, CFG.patch_radius)
    return patches.patch_summary(known, near).select("patch_id", "center_ra", "center_dec", "n_stars", "is_valid")


@register(f"WITH {SP} SELECT patch_id, star_id FROM sp WHERE dist_from_center <= 1.5")
def q_patch_gate(spark, sf_dir):
    return patches.fiducial_cut(projected(spark, sf_dir), 1.5).select("patch_id", "star_id")


@register(f"WITH {SR} SELECT patch_id, star_id, axis, i FROM sr")
def q_sr_members(spark, sf_dir):
    return windows.sr_members(projected(spark, sf_dir), CFG).select("patch_id", "star_id", "axis", "i")


@register(f"WITH {SR} SELECT patch_id, axis, i, n_sr, n_sb FROM good")
def q_sr_counts(spark, sf_dir):
    return windows.gate_srs(windows.sr_counts(projected(spark, sf_dir), CFG), CFG)


@register(f"WITH {CELLS} SELECT patch_id, p, q, star_id, n, ordinal FROM cell")
def q_roi_cells(spark, sf_dir):
    return windows.cells(projected(spark, sf_dir), CFG).select("patch_id", "p", "q", "star_id", "n", "ordinal")


@register(f"WITH {SR}, {_cells(8)} SELECT patch_id, p, q, star_id, n, ordinal FROM cell")
def q_roi_subsample(spark, sf_dir):
    return windows.cells(projected(spark, sf_dir), replace(CFG, max_roi_stars=8)).select("patch_id", "p", "q", "star_id", "n", "ordinal")


@register(f"""WITH {SR}, best AS (SELECT patch_id, arg_max({{'axis': axis, 'i': i}}, n_sr*1000 - i*2 - axis) AS b FROM good GROUP BY patch_id)
SELECT patch_id, b.axis AS axis, b.i AS i, star_id FROM sp JOIN best USING (patch_id)
WHERE NOT (CASE WHEN b.axis = 0 THEN pmra ELSE pmdec END >= -30 + 0.25*b.i AND CASE WHEN b.axis = 0 THEN pmra ELSE pmdec END < -29.5 + 0.25*b.i)""")
def q_sideband_members(spark, sf_dir):
    sp = projected(spark, sf_dir)
    good = windows.gate_srs(windows.sr_counts(sp, CFG), CFG)
    best = good.groupBy("patch_id").agg(F.max_by(F.struct("axis", "i"), F.col("n_sr") * 1000 - F.col("i") * 2 - F.col("axis")).alias("b")).select("patch_id", "b.axis", "b.i")
    return windows.sideband_members(sp, best, CFG).select("patch_id", "axis", "i", "star_id")


@register(f"WITH {SR} SELECT patch_id, axis, i, star_id, round(phi, 6) AS x, round(lam, 6) AS y, round(mu, 6) AS z FROM sr")
def q_features(spark, sf_dir):
    held = windows.sr_members(projected(spark, sf_dir), CFG).withColumn("f", density.features())
    return held.select("patch_id", "axis", "i", "star_id", *[r6(F.col("f")[k], n) for k, n in enumerate("xyz")])


# ---- lines


@register(f"WITH {HOUGH} SELECT patch_id, p, q, t, r, votes FROM votes")
def q_hough_votes(spark, sf_dir):
    return hough.hough_votes(windows.cells(projected(spark, sf_dir), CFG), CFG).select("patch_id", "p", "q", "t", "r", "votes")


@register(f"WITH {HOUGH} SELECT patch_id, p, q, votes, {rounded('theta', 'rho')} FROM peak")
def q_hough_peaks(spark, sf_dir):
    found = hough.hough_peaks(hough.hough_votes(windows.cells(projected(spark, sf_dir), CFG), CFG), CFG)
    return found.select("patch_id", "p", "q", "votes", r6("theta"), r6("rho"))


@register(f"WITH {HOUGH} SELECT patch_id, p, q, n_selected, votes, {rounded('theta', 'rho', 'sigma')} FROM line")
def q_line_significance(spark, sf_dir):
    found = hough.cell_lines(windows.cells(projected(spark, sf_dir), CFG), CFG)
    return found.select("patch_id", "p", "q", "n_selected", "votes", r6("theta"), r6("rho"), r6("sigma"))


@register(f"WITH {ROI} SELECT patch_id, axis, i, j, roi, {rounded('theta', 'rho', 'sigma')} FROM roi")
def q_rois(spark, sf_dir):
    _, found = find_rois(projected(spark, sf_dir), CFG)
    return found.select("patch_id", "axis", "i", "j", "roi", r6("theta"), r6("rho"), r6("sigma"))


@register(f"WITH {ROI} SELECT patch_id, axis, i, j FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY i, axis, j) AS k FROM roi) WHERE k <= 20")
def q_roi_cap(spark, sf_dir):
    _, found = find_rois(projected(spark, sf_dir), replace(CFG, max_rois_per_patch=20))
    return found.select("patch_id", "axis", "i", "j")


@register(f"WITH {HOUGH} SELECT patch_id, p, q, star_id FROM cell JOIN (SELECT patch_id, p, q, theta, rho FROM line) USING (patch_id, p, q) WHERE abs(phi*cos(theta) + lam*sin(theta) - rho) <= 0.1")
def q_on_line(spark, sf_dir):
    held = windows.cells(projected(spark, sf_dir), CFG)
    found = hough.cell_lines(held, CFG).select("patch_id", "p", "q", "theta", "rho")
    return lines.on_line(held.join(found, ["patch_id", "p", "q"]), 0.1).select("patch_id", "p", "q", "star_id")


@register(f"""WITH {HOUGH}, w AS (SELECT *, CASE WHEN sigma > 0 THEN sigma ELSE 0 END AS w FROM line) SELECT patch_id, round(sum(w*theta)/sum(w), 6) AS theta,
 round(sum(w*rho)/sum(w), 6) AS rho, round(sqrt(sum(w*w)), 6) AS sigma FROM w GROUP BY patch_id""")
def q_combine_lines(spark, sf_dir):
    found = hough.cell_lines(windows.cells(projected(spark, sf_dir), CFG), CFG)
    found = found.withColumn("place", F.struct("p", "q"))
    return lines.combine_lines(found, ["patch_id"], "place").select("patch_id", r6("theta"), r6("rho"), r6("sigma"))


_DIGITS = "md5(concat('1-', patch_id, '-', p, '-', q, '-', trial))"


@register(f"""WITH {CELLS}, pt AS (SELECT patch_id, p, q, phi AS x, lam AS y, row_number() OVER (PARTITION BY patch_id, p, q ORDER BY phi, lam) - 1 AS k, count(*) OVER (PARTITION BY patch_id, p, q) AS m FROM cell),
trial AS (SELECT unnest(range(0, 50)) AS trial),
pick AS (SELECT patch_id, p, q, m, trial, cast('0x' || substr({_DIGITS}, 1, 8) AS bigint) % m AS a, cast('0x' || substr({_DIGITS}, 9, 8) AS bigint) % (m - 1) AS step FROM (SELECT DISTINCT patch_id, p, q, m FROM pt WHERE m > 1), trial),
two AS (SELECT d.*, s.x AS x1, s.y AS y1, e.x - s.x AS dx, e.y - s.y AS dy FROM pick d JOIN pt s ON s.patch_id = d.patch_id AND s.p = d.p AND s.q = d.q AND s.k = a
 JOIN pt e ON e.patch_id = d.patch_id AND e.p = d.p AND e.q = d.q AND e.k = (a + 1 + step) % d.m),
ln AS (SELECT patch_id, p, q, trial, atan2(dx, -dy) AS theta, x1*cos(atan2(dx, -dy)) + y1*sin(atan2(dx, -dy)) AS rho FROM two WHERE sqrt(dx*dx + dy*dy) >= 1e-10),
hits AS (SELECT ln.*, count(*) FILTER (abs(cos(theta)*x + sin(theta)*y - rho) <= 0.1) AS inliers FROM ln JOIN pt USING (patch_id, p, q) GROUP BY ALL)
SELECT patch_id, p, q, inliers::int AS inliers, round(theta, 6) AS theta, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, p, q ORDER BY inliers DESC, trial) AS place FROM hits) WHERE place = 1""")
def q_ransac(spark, sf_dir):
    held = windows.cells(projected(spark, sf_dir), CFG)
    return lines.ransac_lines(held, ["patch_id", "p", "q"], 0.1, 50).select("patch_id", "p", "q", "inliers", r6("theta"), r6("rho"))


# ---- scores


_GOOD_SR = f"{SR}, held AS (SELECT sr.*, n_sr, n_sb FROM sr JOIN good USING (patch_id, axis, i))"
_KNN_STEPS = """held AS (SELECT sr.*, n_sr, n_sb FROM sr JOIN good USING (patch_id, axis, i)),
m AS (SELECT patch_id, axis, i, avg(phi) AS mp, avg(lam) AS ml, greatest(sqrt(greatest(var_pop(phi), 1e-10)), 2) AS sd_p, greatest(sqrt(greatest(var_pop(lam), 1e-10)), 2) AS sd_l,
 greatest(3, least(greatest(3, least(15, any_value(n_sb))), any_value(n_sr) // 2)) AS k FROM held GROUP BY ALL),
xy AS (SELECT patch_id, axis, i, star_id, k, n_sr, cast((phi - mp)/sd_p AS float) AS x, cast((lam - ml)/sd_l AS float) AS y FROM held JOIN m USING (patch_id, axis, i)),
d AS (SELECT a.patch_id, a.axis, a.i, a.star_id, a.k, a.n_sr, cast((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS float) AS d2
 FROM xy a JOIN xy b ON a.patch_id = b.patch_id AND a.axis = b.axis AND a.i = b.i),
kth AS (SELECT patch_id, axis, i, star_id, greatest(sqrt(cast(d2 AS double)), 0.01) AS r FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, axis, i, star_id ORDER BY d2) - 1 AS place FROM d)
 WHERE place = least(k, n_sr - 1)),
rs AS (SELECT patch_id, axis, i, avg(r) AS mr, sqrt(CASE WHEN avg(r*r) - avg(r)*avg(r) > 0 THEN avg(r*r) - avg(r)*avg(r) ELSE 0.01 END) AS sr FROM kth GROUP BY ALL),
knn AS (SELECT patch_id, axis, i, star_id, (mr - r)/sr AS score FROM kth JOIN rs USING (patch_id, axis, i))"""
KNN = f"{SR}, {_KNN_STEPS}"


def _scored(spark, sf_dir, method: str) -> DataFrame:
    sp = projected(spark, sf_dir)
    return density.score(sp, windows.gate_srs(windows.sr_counts(sp, CFG), CFG), CFG, method)


@register(f"WITH {KNN} SELECT patch_id, axis, i, star_id, round(score, 4) AS score FROM knn")
def q_knn_score(spark, sf_dir):
    return _scored(spark, sf_dir, "knn").withColumn("score", F.round("score", 4))


@register(f"WITH {KNN} SELECT patch_id, star_id, round(arg_max(score, i*2 + axis), 4) AS score FROM knn GROUP BY patch_id, star_id")
def q_last_score(spark, sf_dir):
    return density.last_scores(_scored(spark, sf_dir, "knn")).withColumn("score", F.round("score", 4))


def _edges(c: str) -> str:
    return f"""CASE WHEN max({c}) FILTER (NOT inside) - min({c}) FILTER (NOT inside) < 1e-10 THEN 1 ELSE max({c}) FILTER (NOT inside) - min({c}) FILTER (NOT inside) END AS w_{c},
 min({c}) FILTER (NOT inside) AS l_{c}, max({c}) FILTER (NOT inside) AS h_{c}"""


def _bin(c: str) -> str:
    return f"least(9, greatest(0, cast(floor(({c} - (l_{c} - 0.1*w_{c}))/(((h_{c} + 0.1*w_{c}) - (l_{c} - 0.1*w_{c}))/10)) AS int)))"


@register(f"""WITH {SR}, rich AS (SELECT * FROM good WHERE n_sb >= 100),
ev AS (SELECT r.*, star_id, phi, lam, CASE WHEN axis = 0 THEN mu_lam ELSE mu_phi END AS mu, CASE WHEN axis = 0 THEN pmra ELSE pmdec END >= -30 + 0.25*i
 AND CASE WHEN axis = 0 THEN pmra ELSE pmdec END < -29.5 + 0.25*i AS inside FROM sp JOIN rich r USING (patch_id)),
ends AS (SELECT patch_id, axis, i, {_edges('phi')}, {_edges('lam')}, {_edges('mu')} FROM ev GROUP BY ALL),
pl AS (SELECT ev.*, {_bin('phi')} AS x, {_bin('lam')} AS y, {_bin('mu')} AS z FROM ev JOIN ends USING (patch_id, axis, i)),
h AS (SELECT patch_id, axis, i, x, y, z, count(*) FILTER (inside) AS a, count(*) FILTER (NOT inside) AS b FROM pl GROUP BY ALL)
SELECT patch_id, axis, i, star_id, round(((a+1)/(n_sr + 100000))/((b+1)/(n_sb + 100000)), 6) AS score FROM pl JOIN h USING (patch_id, axis, i, x, y, z) WHERE inside""")
def q_hist_score(spark, sf_dir):
    return _scored(spark, sf_dir, "histogram").withColumn("score", F.round("score", 6))


def _silver(c: str, least: float) -> str:
    spread = f"(l_{c}[3*n//4 + 1] - l_{c}[n//4 + 1])/1.34"
    scale = f"least(s_{c}, {spread})"
    return f"greatest({least}, 0.9*(CASE WHEN {scale} < 1e-10 THEN s_{c} ELSE {scale} END)*pow(n, -0.2)) AS h_{c}"


_PM = "CASE WHEN axis = 0 THEN pmra ELSE pmdec END"


@register(f"""WITH {SR}, rich AS (SELECT * FROM src WHERE n_sr >= 10 AND n_sb >= 100),
ev AS (SELECT r.patch_id, r.axis, r.i, star_id, phi, lam, CASE WHEN axis = 0 THEN mu_lam ELSE mu_phi END AS mu, {_PM} >= -30 + 0.25*i AND {_PM} < -29.5 + 0.25*i AS inside FROM sp JOIN rich r USING (patch_id)),
hw AS (SELECT patch_id, axis, i, inside, count(*) AS n, {', '.join(f'stddev_samp({c}) AS s_{c}, list_sort(list({c})) AS l_{c}' for c in ('phi', 'lam', 'mu'))} FROM ev GROUP BY ALL),
hb AS (SELECT patch_id, axis, i, inside, {_silver('phi', 2.0)}, {_silver('lam', 2.0)}, {_silver('mu', 0.0)} FROM hw),
bw AS (SELECT ev.*, h_phi, h_lam, h_mu FROM ev JOIN hb USING (patch_id, axis, i, inside)),
k AS (SELECT a.patch_id, a.axis, a.i, a.star_id, b.inside, avg(exp(-0.5*(pow((a.phi-b.phi)/b.h_phi, 2) + pow((a.lam-b.lam)/b.h_lam, 2) + pow((a.mu-b.mu)/b.h_mu, 2))))
 / any_value(b.h_phi*b.h_lam*b.h_mu) AS d FROM ev a JOIN bw b ON a.patch_id = b.patch_id AND a.axis = b.axis AND a.i = b.i WHERE a.inside GROUP BY ALL)
SELECT patch_id, axis, i, star_id, round(max(d) FILTER (inside)/max(d) FILTER (NOT inside), 6) AS score FROM k GROUP BY ALL""")
def q_kde_score(spark, sf_dir):
    sp = projected(spark, sf_dir)
    regions = windows.sr_counts(sp, CFG).where(F.col("n_sr") >= CFG.min_stars_sr)  # the scan's upper bound is none of the kernel score's
    return density.score(sp, regions, CFG, "kde").withColumn("score", F.round("score", 6))


@register(f"""WITH {_GOOD_SR}, o AS (SELECT patch_id, axis, i, phi, n_sr, row_number() OVER (PARTITION BY patch_id, axis, i ORDER BY phi) - 1 AS k FROM held),
s AS (SELECT patch_id, axis, i, count(*) AS n, stddev_samp(phi) AS sd, (max(phi) FILTER (k = 3*n_sr//4) - max(phi) FILTER (k = n_sr//4))/1.34 AS iq FROM o GROUP BY ALL)
SELECT patch_id, axis, i, round(0.9*(CASE WHEN least(sd, iq) < 1e-10 THEN sd ELSE least(sd, iq) END)*pow(n, -0.2), 6) AS h FROM s""")
def q_silverman(spark, sf_dir):
    sp = projected(spark, sf_dir)
    held = windows.sr_members(sp, CFG).join(windows.gate_srs(windows.sr_counts(sp, CFG), CFG), ["patch_id", "axis", "i"])
    return selection.silverman_bandwidths(held, ["patch_id", "axis", "i"], "phi").withColumn("h", F.round("h", 6))


_EMB = "e AS (SELECT vec_id, label, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings)"


@register(f"""WITH {_EMB}, d AS (SELECT p.label, p.vec_id AS query_id, q.vec_id AS point_id, cast(cast((p.a-q.a)*(p.a-q.a) AS float) + cast((p.b-q.b)*(p.b-q.b) AS float) AS float) + cast((p.c-q.c)*(p.c-q.c) AS float) AS d
 FROM e p JOIN e q ON p.label = q.label)
SELECT label, query_id, cast(rank AS int) AS rank, point_id, round(cast(d AS double), 6) AS dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS rank FROM d) WHERE rank <= 5""")
def q_knn_dist(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].alias(n) for k, n in enumerate("abc")])
    return knn.knn(e, e.withColumnRenamed("point_id", "query_id"), 5, ["a", "b", "c"], ["label"]).withColumn("dist_sq", F.round("dist_sq", 6))


@register("""WITH e AS (SELECT vec_id, label, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS x, embedding[5] AS y, embedding[6] AS z FROM embeddings),
d AS (SELECT p.label, p.vec_id AS query_id, q.vec_id AS point_id, cast(cast((p.x-q.a)*(p.x-q.a) AS float) + cast((p.y-q.b)*(p.y-q.b) AS float) AS float)
 + cast(((p.z-q.c)*cast(0.5 AS float))*((p.z-q.c)*cast(0.5 AS float)) AS float) AS d FROM e p JOIN e q ON p.label = q.label)
SELECT label, query_id, point_id, round(cast(d AS double), 6) AS dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS rank FROM d) WHERE rank = 1""")
def q_nearest_scaled(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # two catalogues of all rows: one by the first three dimensions, the other by the next three
    at = lambda key, first: e.select("label", F.col("vec_id").alias(key), *[F.col("embedding")[first + k].alias(n) for k, n in enumerate("abc")])
    return knn.nearest(at("point_id", 0), at("query_id", 3), ["a", "b", "c"], ["label"], [1.0, 1.0, 0.5]).withColumn("dist_sq", F.round("dist_sq", 6))


# ---- statistics


@register("""SELECT o_custkey, round(coalesce(avg(o_totalprice), 0), 6) AS mean, round(coalesce(var_samp(o_totalprice), 0)/1e6, 4) AS variance_m, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std,
 round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, min(o_totalprice) AS p0 FROM orders GROUP BY o_custkey""")
def q_stats(spark, sf_dir):
    found = selection.group_statistics(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], "o_totalprice", {"median": 50, "p90": 90, "p0": 0})
    return found.select("o_custkey", r6("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance_m"), F.round("std", 4).alias("std"), r6("median"), r6("p90"), "p0")


@register("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999
 FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag""")
def q_large_group_quantiles(spark, sf_dir):
    """Groups that are most of a table: places come from refined histograms."""
    found = selection.quantiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice", {"p5": 5, "median": 50, "p999": 99.9})
    return found.select("l_returnflag", "n", r6("p5"), r6("median"), r6("p999"))


@register(f"""WITH {SP} SELECT patch_id, round(coalesce(stddev_samp(rv) FILTER (abs(rv) > 0.001 AND abs(rv) < 1000), 0), 6) AS dispersion,
 round(avg(distance) FILTER (distance > 0.1 AND distance < 500), 6) AS mean_dist FROM sp GROUP BY patch_id""")
def q_rv_dispersion(spark, sf_dir):
    sp = projected(spark, sf_dir)
    return sp.groupBy("patch_id").agg(r6(stats.rv_dispersion(), "dispersion")).join(density.valid_moments(sp, ["patch_id"]), "patch_id").select("patch_id", "dispersion", r6("mean_dist"))


_VALID = {"dist": ("distance", "distance > 0.1 AND distance < 500"), "rv": ("rv", "abs(rv) > 0.001 AND abs(rv) < 1000")}


@register(f"WITH {SP} SELECT patch_id, {', '.join(f'round({f}({c}) FILTER ({ok}), 6) AS {n}_{k}' for k, (c, ok) in _VALID.items() for n, f in (('mean', 'avg'), ('std', 'stddev_pop')))} FROM sp GROUP BY patch_id")
def q_valid_moments(spark, sf_dir):
    found = density.valid_moments(projected(spark, sf_dir), ["patch_id"])
    return found.select("patch_id", *[r6(f"{n}_{k}") for k in _VALID for n in ("mean", "std")])


@register("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 AND trim(o_orderstatus) = 'F'""")
def q_quality_filter(spark, sf_dir):
    """The cut of good stars, by a warning number and a padded class."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", F.pmod("o_orderkey", F.lit(5)).alias("rvs_warn"), F.when(F.col("o_orderstatus") == "F", F.lit(" STAR  ")).otherwise(F.lit("GALAXY")).alias("rr_spectype"))
    return prep.good_stars(rows).select("o_orderkey", "o_totalprice")


# ---- clusters


def _found(spark, sf_dir):
    held, rois = find_rois(projected(spark, sf_dir), CFG)
    return held, rois


@register(f"WITH {EDGES} SELECT src, dst FROM edge")
def q_roi_edges(spark, sf_dir):
    held, rois = _found(spark, sf_dir)
    return clusters.roi_edges(rois, held, CFG)


_TEN = """SELECT patch_id, p, q, avg(mu_phi) AS m_phi, avg(mu_lam) AS m_lam, avg(distance) FILTER (distance > 0.1 AND distance < 500) AS m_dist,
 count(*) FILTER (abs(rv) > 0.001 AND abs(rv) < 1000) AS n_rv, sum(rv) FILTER (abs(rv) > 0.001 AND abs(rv) < 1000) AS s_rv, sum(rv*rv) FILTER (abs(rv) > 0.001 AND abs(rv) < 1000) AS s2_rv
 FROM cell WHERE ordinal < 10 GROUP BY patch_id, p, q"""


@register(f"""WITH {ROI}, ten AS ({_TEN}), full_roi AS (SELECT roi.*, m_phi, m_lam, m_dist, n_rv, s_rv, s2_rv FROM roi JOIN ten USING (patch_id, p, q)),
pair AS (SELECT a.roi AS src, b.roi AS dst, a.m_dist AS d1, b.m_dist AS d2, a.n_rv AS n1, b.n_rv AS n2, a.s_rv AS s1, b.s_rv AS s2, a.n_rv + b.n_rv AS n, a.s_rv + b.s_rv AS s, a.s2_rv + b.s2_rv AS ss
 FROM full_roi a JOIN full_roi b ON a.patch_id = b.patch_id AND a.roi < b.roi AND (a.axis <> b.axis OR a.i <> b.i)
 AND sqrt(pow(a.m_phi-b.m_phi,2) + pow(a.m_lam-b.m_lam,2)) < 5 AND {sql_compatible('a', 'b')})
SELECT src, dst FROM pair WHERE NOT coalesce(abs(d1 - d2) > 15 AND abs(d1 - d2)/((d1 + d2)/2) > 0.15, false)
 AND NOT coalesce(abs(s1/n1 - s2/n2) > 10 OR (n > 2 AND sqrt(greatest(ss - s*s/n, 0)/(n - 1)) > {CFG.max_rv_dispersion}), false)""")
def q_roi_edges_gated(spark, sf_dir):
    """Pairs of regions whose distances and radial velocities agree as well."""
    held, rois = _found(spark, sf_dir)
    return clusters.roi_edges(rois, held, replace(CFG, use_distance=True, use_rv=True))


_CLU = rounded("significance", "theta", "rho", "mean_mu_phi", "mean_mu_lam", "std_mu_phi", "std_mu_lam")


@register(f"WITH RECURSIVE {CLUSTERS} SELECT patch_id, cluster, n_rois, n_line_stars, is_edge, {_CLU} FROM clu")
def q_protoclusters(spark, sf_dir):
    held, rois = _found(spark, sf_dir)
    found, _, _ = clusters.protoclusters(rois, held, CFG)
    return found.select("patch_id", "cluster", "n_rois", "n_line_stars", "is_edge", *[r6(c) for c in ("significance", "theta", "rho", "mean_mu_phi", "mean_mu_lam", "std_mu_phi", "std_mu_lam")])


@register(f"WITH RECURSIVE {CLUSTERS} SELECT cluster, cluster_2, shared, round(overlap, 6) AS overlap FROM olap WHERE patch_1 <> patch_2")
def q_star_overlap(spark, sf_dir):
    held, rois = _found(spark, sf_dir)
    _, _, stars = clusters.protoclusters(rois, held, CFG)
    return clusters.star_overlap(stars, False).withColumn("overlap", F.round("overlap", 6))


@register(f"WITH RECURSIVE {STREAMS} SELECT patch_id, protostream, is_edge, n_clusters, round(significance, 6) AS significance FROM ps")
def q_protostreams(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, demo_patches(spark))
    return run.streams.select("patch_id", "protostream", "is_edge", "n_clusters", r6("significance"))


@register(f"WITH RECURSIVE {STREAMS} SELECT src, dst FROM medge")
def q_merge_edges(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, demo_patches(spark))
    _, bridge = clusters.protostreams(run.clusters, run.cluster_stars, CFG)
    return clusters.merge_edges(bridge, run.cluster_stars, CFG)


# two patches that lie close together, so that they share enough of the stream's stars to merge
CLOSE = [(0, 179.5, 49.8, 0.0, 0.0), (1, 179.9, 50.0, 0.0, 0.0)]
_CLOSE = "patches(patch_id, center_ra, center_dec, center_l, center_b) AS (VALUES " + ", ".join(f"({p}, '{a}'::double, '{d}'::double, 0.0::double, 0.0::double)" for p, a, d, _, _ in CLOSE) + ")"


@register(f"WITH RECURSIVE {STREAMS.replace(_patch_values(), _CLOSE)} SELECT src, dst FROM medge")
def q_close_merge_edges(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, patches.patches_frame(spark, CLOSE))
    _, bridge = clusters.protostreams(run.clusters, run.cluster_stars, CFG)
    return clusters.merge_edges(bridge, run.cluster_stars, CFG)


@register(f"WITH RECURSIVE {CANDIDATES.replace(_patch_values(), _CLOSE)} SELECT candidate_id, candidate, n_protostreams, n_stars, {rounded('significance', 'mean_ra', 'mean_dec')} FROM cand")
def q_merged_candidates(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, patches.patches_frame(spark, CLOSE))
    return run.candidates.select("candidate_id", "candidate", "n_protostreams", "n_stars", *[r6(c) for c in ("significance", "mean_ra", "mean_dec")])


_CAND = ["significance", "mean_ra", "mean_dec", "mean_pmra", "mean_pmdec", "mean_l", "mean_b"]


@register(f"""WITH RECURSIVE {CANDIDATES} SELECT 'stream_candidates.csv' AS file, cast(candidate_id AS varchar) AS row_id, format('{{:.2f}}', significance) AS significance, format('{{:.6f}}', mean_ra) AS ra FROM cand
UNION ALL SELECT format('stream_{{:03d}}_stars.csv', candidate_id), format('{{:.8f}}', ra), format('{{:.2f}}', significance), NULL FROM member JOIN cand USING (candidate) WHERE candidate_id <= 20""")
def q_named_files(spark, sf_dir):
    """The files of candidates and of their members, written by tasks and read back."""
    run = detect(demo_stars(spark, sf_dir), CFG, None, demo_patches(spark))
    path = shared_path(spark, "named")
    sinks.write_named_files(run.candidates, run.members, path)
    found = spark.read.csv(f"{path}/stream_*.csv", header=False).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "*")
    first = found.where("file = 'stream_candidates.csv' and _c0 <> 'candidate_id'")
    stars = found.where("file <> 'stream_candidates.csv' and _c0 <> 'ra'")
    one = first.select("file", F.col("_c0").alias("row_id"), F.col("_c2").alias("significance"), F.col("_c5").alias("ra"))
    return one.unionByName(stars.select("file", F.col("_c0").alias("row_id"), F.col("_c16").alias("significance"), F.lit(None).cast("string").alias("ra")))


@register(f"WITH RECURSIVE {CANDIDATES} SELECT candidate_id, candidate, n_protostreams, n_stars, {rounded(*_CAND)} FROM cand")
def q_candidates(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, demo_patches(spark))
    return run.candidates.select("candidate_id", "candidate", "n_protostreams", "n_stars", *[r6(c) for c in _CAND])


@register(f"""WITH RECURSIVE {CANDIDATES}, {_KNN_STEPS}, last AS (SELECT patch_id, star_id, arg_max(score, i*2 + axis) AS score FROM knn GROUP BY patch_id, star_id)
SELECT candidate_id, m.patch_id, m.star_id, round(ra, 6) AS ra, round(coalesce(score, 0), 4) AS anomaly_score
FROM member m JOIN cand USING (candidate) LEFT JOIN last ON last.patch_id = m.patch_id AND last.star_id = m.star_id""")
def q_candidate_members(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, "knn", demo_patches(spark))
    return run.members.select("candidate_id", "patch_id", "star_id", r6("ra"), F.round("anomaly_score", 4).alias("anomaly_score"))


@register(f"WITH RECURSIVE {CANDIDATES} SELECT candidate_id, n_stars, {rounded('significance', 'mean_ra', 'mean_dec', 'mean_pmra', 'mean_pmdec')} FROM cand WHERE candidate_id <= 10")
def q_top_candidates(spark, sf_dir):
    run = detect(demo_stars(spark, sf_dir), CFG, None, demo_patches(spark))
    return sinks.report(run.candidates, 10).select("candidate_id", "n_stars", *[r6(c) for c in ("significance", "mean_ra", "mean_dec", "mean_pmra", "mean_pmdec")])


# ---- other


TILES = "tiles AS (SELECT 176 + (s_suppkey*37 % 800)/100.0::double AS tile_ra, 46 + (s_suppkey*53 % 800)/100.0::double AS tile_dec, 1 + s_suppkey % 3 AS passes FROM supplier)"


@register(f"WITH {STARS}, {TILES} SELECT star_id, coalesce(sum(passes) FILTER ({sql_sep('ra', 'dec', 'tile_ra', 'tile_dec')} <= 1.6), 0)::bigint AS coverage FROM stars, tiles GROUP BY star_id")
def q_coverage_tiles(spark, sf_dir):
    """A survey's plan, a tile for each supplier."""
    at = lambda first, step: first + F.pmod(F.col("s_suppkey") * step, F.lit(800)) / 100.0
    tiles = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(at(176.0, 37).alias("tile_ra"), at(46.0, 53).alias("tile_dec"), (1 + F.pmod("s_suppkey", F.lit(3))).alias("passes"))
    return coverage.tile_coverage(demo_stars(spark, sf_dir).select("star_id", "ra", "dec"), tiles, 1.6).select("star_id", "coverage")


@register("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events)
SELECT o_orderkey, event_id FROM a JOIN b USING (k)""")
def q_hstack(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    right = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return prep.hstack(left, right, ["o_orderkey"], ["event_id"])


@register(f"""WITH {STARS}, moved AS (SELECT ra + 4e-7 AS ra2, dec AS dec2 FROM stars WHERE star_id % 3 = 0),
hit AS (SELECT DISTINCT star_id FROM stars JOIN moved ON abs(ra - ra2) < 1e-6 AND abs(dec - dec2) < 1e-6)
SELECT round((SELECT count(*) FROM hit)/(SELECT count(*) FROM stars), 6) AS overlap""")
def q_position_overlap(spark, sf_dir):
    stars = demo_stars(spark, sf_dir)
    moved = stars.where("star_id % 3 = 0").withColumn("ra", F.col("ra") + 4e-7)
    return clusters.position_overlap(stars, moved).withColumn("overlap", F.round("overlap", 6))
