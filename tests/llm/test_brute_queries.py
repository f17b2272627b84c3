"""The registered op4 query and the pipeline's mixing stage against plain Python over a whole small table."""

import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import xxhash

from skyloom.llm import queries
from skyloom.llm.mixing import mix_sources, sized_documents

SF = "/root/testdata/sf0.001"


def test_op4_columns_and_laws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op4_histogram_sort(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    held, slots = defaultdict(int), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, even = max(r["size"] for r in got), sum(held.values()) / 40
    assert all(abs(held.get(k, 0) - even) <= 2 * largest for k in range(40))


def test_mixing_stage_takes_the_smallest_hashes(spark):
    """Each source's whole rounds, and once more its rows of smallest hash, as near to the target as a row allows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    spread = {r["doc_id"]: xxhash.xxh64((r["text"] or "").encode(), seed=xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest()).intdigest() >> 4 for r in rows}
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    target = {r["source"]: r["target"] for r in mix_sources(sized_documents(docs)).select("source", "target").distinct().collect()}
    got = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, SF).collect())
    for source in target:
        own = sorted((r["doc_id"] for r in rows if r["source"] == source), key=spread.get)
        total = sum(size[i] for i in own)
        rounds, rest = int(target[source] // total), target[source] % total
        upto, more = 0, []
        for i in own:
            if upto + size[i] > rest:  # the row that passes the goal stays where that is nearer
                if rest - upto > size[i] / 2:
                    more.append(i)
                break
            upto += size[i]
            more.append(i)
        assert {i: got[i] for i in own} == {i: rounds + (i in more) for i in own}, source
    assert sum(got.values()) == corpus_pipeline.mixing(spark, docs, SF).count()
