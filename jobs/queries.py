"""The jobs as registered queries: each runs twice into one new folder and returns what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import note_outliers, survey_ingest
from skyloom.queries import SR
from skyloom.session import shared_path


def job1_survey_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars in patches and signal regions of the whole events table, as one table: the second run finds nothing new."""
    folder = shared_path(spark, "job1", keep=True)
    for _ in range(2):
        survey_ingest.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/checkpoint")
    stars, regions = survey_ingest.read_output(spark, f"{folder}/out")
    none = F.lit(None)
    star = stars.select(F.lit("star").alias("part"), "patch_id", "star_id", none.cast("int").alias("axis"), none.cast("int").alias("i"), none.cast("long").alias("n_sr"), none.cast("long").alias("n_sb"), F.round("phi", 6).alias("phi"))
    region = regions.select(F.lit("region").alias("part"), "patch_id", none.cast("long").alias("star_id"), "axis", "i", "n_sr", "n_sb", none.cast("double").alias("phi"))
    return star.unionByName(region)


JOB1_SQL = f"""WITH {SR} SELECT 'star' AS part, patch_id, star_id, NULL::int AS axis, NULL::int AS i, NULL::bigint AS n_sr, NULL::bigint AS n_sb, round(phi, 6) AS phi FROM sp_all
UNION ALL SELECT 'region', patch_id, NULL, axis, i::int, n_sr, n_sb, NULL FROM good"""


def job2_note_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents and the summary of their sources, as one table: the second run writes the same partitions again."""
    output = f"{shared_path(spark, 'job2', keep=True)}/out"
    for _ in range(2):
        note_outliers.run(spark, f"{sf_dir}/documents.parquet", output)
    records, summary = note_outliers.read_output(spark, output)
    r4 = lambda c: F.round(c, 4).alias(c)
    none = F.lit(None)
    row = records.select(F.lit("record").alias("part"), "doc_id", "lang", "source", "words", r4("length"), r4("lines"), r4("kth_distance"), r4("score"), "flagged", none.cast("long").alias("records"), none.cast("long").alias("n_flagged"))
    total = summary.select(
        F.lit("summary").alias("part"), none.cast("long").alias("doc_id"), "lang", "source", *[none.cast("double").alias(c) for c in ("words", "length", "lines", "kth_distance")],
        F.round("lowest", 4).alias("score"), none.cast("boolean").alias("flagged"), "records", F.col("flagged").alias("n_flagged"),
    )
    return row.unionByName(total)


def _z(c: str) -> str:
    wide = f"l_{c}[3*n//4 + 1] - l_{c}[n//4 + 1]"
    return f"cast(({c} - l_{c}[n//2 + 1]) / (CASE WHEN {wide} > 0 THEN {wide} ELSE 1 END) AS float) AS z_{c}"


_KINDS = ("words", "length", "lines")
JOB2_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, lang, source, len(regexp_extract_all(t, '[^ 	-
]+'))::double AS words, length(t) AS chars, length(t) - length(replace(t, chr(10), '')) AS breaks FROM d),
f AS (SELECT doc_id, lang, source, words, chars/greatest(words, 1) AS length, breaks*1000/greatest(words, 1) AS lines FROM c),
one AS (SELECT doc_id, unnest(max({{'lang': lang, 'source': source, 'words': words, 'length': length, 'lines': lines}})) FROM f GROUP BY doc_id),
q AS (SELECT lang, count(*) AS n, {', '.join(f'list_sort(list({c})) AS l_{c}' for c in _KINDS)} FROM one GROUP BY lang),
z AS (SELECT one.*, n, {', '.join(_z(c) for c in _KINDS)} FROM one JOIN q USING (lang)),
near AS (SELECT a.lang, a.doc_id, cast(cast((a.z_words-b.z_words)*(a.z_words-b.z_words) + (a.z_length-b.z_length)*(a.z_length-b.z_length) AS float) + (a.z_lines-b.z_lines)*(a.z_lines-b.z_lines) AS float) AS d
 FROM z a JOIN z b ON a.lang = b.lang),
kth AS (SELECT lang, doc_id, sqrt(max(d)::double) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM near) WHERE k <= {note_outliers.DEFAULTS['neighbours'] + 1} GROUP BY ALL),
m AS (SELECT lang, avg(r) AS mean, stddev_pop(r) AS std, count(*) AS n FROM kth GROUP BY lang),
s AS (SELECT z.doc_id, z.lang, source, words, length, lines, r, CASE WHEN std > 1e-9 AND m.n >= {note_outliers.DEFAULTS['least_group']} THEN (mean - r)/std ELSE 0 END AS score FROM z JOIN kth USING (lang, doc_id) JOIN m USING (lang))
SELECT 'record' AS part, doc_id, lang, source, words, round(length, 4) AS length, round(lines, 4) AS lines, round(r, 4) AS kth_distance, round(score, 4) AS score,
 score < {note_outliers.DEFAULTS['flag_below']} AS flagged, NULL::bigint AS records, NULL::bigint AS n_flagged FROM s
UNION ALL SELECT 'summary', NULL, lang, source, NULL, NULL, NULL, NULL, round(min(score), 4), NULL, count(*), count(*) FILTER (score < {note_outliers.DEFAULTS['flag_below']}) FROM s GROUP BY lang, source"""

QUERIES = {"job1_survey_ingest": job1_survey_ingest, "job2_note_outliers": job2_note_outliers}
ORACLES = {"job1_survey_ingest": JOB1_SQL, "job2_note_outliers": JOB2_SQL}
