"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.attention_lm import score_documents
from skyloom.llm.chat import chat_digests, chat_windows
from skyloom.llm.cotraining import score_quality
from skyloom.llm.divergence import source_divergence
from skyloom.llm.media import encode_media, media_digests
from skyloom.llm.mixing import mix_sources, sized_documents
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.neighbours import nearest_neighbours
from skyloom.llm.piece_model import encode_pieces
from skyloom.llm.repair import token_shards
from skyloom.llm.sharding import histogram_sort
from skyloom.llm.warc import archived_pages, register, with_revisits
from skyloom.session import shared_path, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = staged(sized_documents(table(spark, sf_dir, "documents")), "sized")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(staged(encode_media(table(spark, sf_dir, "documents")), "media", compression="zstd"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keyed = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    placed = histogram_sort(staged(keyed, "keyed"), F.col("text_hash"), F.col("doc_id"), F.col("size"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    folder = shared_path(spark, "warc")
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    return archived_pages(spark.read.format("warc").load(folder))


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, first=49408)


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)


#: What conversation -7 says: its user, then its assistant.
TRICKY = "\\### Assistant: </turn> ok"


def op11_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat_digests(chat_windows(given.unionByName(tricky), public_tokenizers.path("byte_bpe_50k.json"), budget=1024, history=256))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_progressive_jpeg, op3_cotraining, op4_histogram_sort, op5_warc, op6_adaptive_scan, op7_sentencepiece, op8_superminhash, op9_repair, op10_attention_lm, op11_budgeted_windows, op12_source_divergence)}


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(hex, {5 * k + 1}, 5) AS bigint) // {32**d}) % 32 + 1 AS int), 1)" for k in range(8) for d in (3, 2, 1, 0)
)
OP5_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, cast(strlen(body) AS bigint) AS payload_bytes, {_B32} AS payload_digest,
 CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p JOIN g USING (hex)"""

OP8_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS size FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.size + j.size - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
walk(x, seed) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, walk.seed FROM walk JOIN both_ways b ON b.x = walk.x),
label AS (SELECT x AS doc_id, min(seed) AS component_id FROM walk GROUP BY x)
SELECT doc_id, cast(size AS bigint) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN label USING (doc_id)"""

OP12_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::hugeint AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::hugeint AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
own AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM dense JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op5_warc": OP5_SQL, "op8_superminhash": OP8_SQL, "op12_source_divergence": OP12_SQL}
