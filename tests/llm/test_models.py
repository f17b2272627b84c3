"""Search, tokenizer parity and classifier on small tables."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skyloom.llm import cotraining, neighbours
from skyloom.llm.cotraining import TEXT_DIMS, TRIGRAMS, fit_quality, keep_quality, score_quality, text_view, trigrams
from skyloom.llm.neighbours import adaptive_scan, lifted, nearest_neighbours, rotation
from skyloom.llm.piece_model import PieceCodec, encode_pieces, fields_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "\n\n", "\t x", "▁▁a", "<s></s><unk>", "a" * 300, "日本語 テスト", "👩‍👩‍👧 x́ ﻿ \x00 z", "\xa0x　y", "é ﬁ ①", "a ▁ b", "x  ", "Don't stop - 12.5%"]


# ---- neighbours


def vectors(seed, n=700, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[100:400] = x[7]
    return x


def search(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return nearest_neighbours(df, "vec_id", "embedding", F.col("id") % 20 == 0, **more).collect()


def test_all_lists_give_exact_results(spark, monkeypatch):
    x = vectors(1)
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [1.0] * 3, ""), (None, [1.0] * 16, ""), (2080, [None] * 16, "")]
    got = collections.defaultdict(list)
    monkeypatch.setattr(neighbours, "FIRST_SHARE", 1.0)
    monkeypatch.setattr(neighbours, "EPSILON", 50.0)
    for r in search(spark, rows, n_lists=9):
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -np.round(scores, 9))) if i != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert np.allclose([r["score"] for r in found], scores[order]) and np.allclose([r["score"] for r in found], [scores[r["vec_id"]] for r in found])
        ties = [r["vec_id"] for r in found if 100 <= r["vec_id"] < 400]
        assert ties == sorted(ties)


def test_recall_and_small_tables(spark):
    x = vectors(2)
    hits = total = 0
    found = collections.defaultdict(set)
    for r in search(spark, [(i, v.tolist(), "s") for i, v in enumerate(x)]):
        found[r["query_id"]].add(r["vec_id"])
    for q in range(0, 700, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-20]
        hits += sum(scores[v] >= least - 1e-9 for v in found[q])
        total += 20
    assert hits / total >= 0.9
    few = search(spark, [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (2, [-1.0, 0.0], "")])
    assert [(r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 0.5), (2, -1.0)]
    assert search(spark, []) == [] and search(spark, [(1, None, "")]) == []


@pytest.mark.parametrize("kind", ["even", "clusters", "one huge"])
def test_recall_of_lists_and_scan_alone(spark, monkeypatch, kind):
    """Far more rows than the sample has, whose finds are not used."""
    monkeypatch.setattr(neighbours, "FLOOR_ROWS", 60)
    monkeypatch.setattr(neighbours, "_filler", None)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((8000, 24))
    if kind == "clusters":
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 8000)] * 3 + x * 0.4
    if kind == "one huge":
        x[77] *= 500
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as list", "2 as floor").repartition(4)
    found = collections.defaultdict(set)
    for r in nearest_neighbours(df, "vec_id", "embedding", F.col("id") % 40 == 0).collect():
        assert r["score"] == pytest.approx(x[r["query_id"]] @ x[r["vec_id"]], rel=1e-12)
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 8000, 40):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
        assert len(found[q]) == 20
    assert hits / 4000 >= 0.95


def test_exact_search_equals_comparing_all(spark):
    """Evenly spread vectors, of which the test by chance alone would lose some, with the same answers as all products."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 20))
    x[3000:3040] = x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in sorted(nearest_neighbours(df, "vec_id", "embedding", F.col("id") % 50 == 0, exact=True, n_lists=24).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    for q in range(0, 6000, 50):
        scores = np.array([x[q] @ v for v in x])
        scores[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(6000), -np.round(scores, 10)))[:20].tolist()


def test_a_query_is_sent_once_to_a_block():
    """However many of its lists it visits."""
    rng = np.random.default_rng(4)
    centres, count = rng.standard_normal((40, 8)), rng.integers(0, 300, 40).astype(float)
    known = neighbours.Lists(centres, count, np.full(40, 2.0), np.full(40, 1.0), np.zeros(40, np.int64), False)
    known.blocks(1000)
    assert known.block.max() + 1 <= math.ceil(count.sum() / 1000) + 1
    x = rng.standard_normal((50, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist()), pa.array([-1e9] * 50)], ["id", "vec", "floor"])
    for later in (False, True):
        rows = [r for b in neighbours._router(known, 4, later)([batch]) for r in b.to_pylist()]
        assert len({(r["id"], r["block"]) for r in rows}) == len(rows)
        want = known.choose(x, np.full(50, -1e9), 4, later)
        got = collections.defaultdict(list)
        for r in rows:
            assert all(known.block[i] == r["block"] for i in r["lists"]) and r["vec"] == x[r["id"]].tolist()
            got[r["id"]] += r["lists"]
        assert all(sorted(got[i]) == sorted(want[i].tolist()) for i in range(50))


def test_adaptive_scan_keeps_near_rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 63))
    radius = np.linalg.norm(x, axis=1).max()
    t = lifted(x, radius, False) @ rotation(64)
    q = lifted(x[:1], radius, True)[0] @ rotation(64)
    d = ((t - q) ** 2).sum(1)
    limit = np.sort(d)[50]
    other = t[5] * 1.5
    asks, rows = adaptive_scan(np.stack([q, other]), t, np.array([limit * (1 + 1e-9), ((t - other) ** 2).sum(1).max() * 1.01]))
    left = rows[asks == 0]
    assert (d[left] <= limit * (1 + 1e-8)).all() and len(left) >= 48
    assert (asks == 1).sum() >= 1990  # a limit that holds all: chance drops few


# ---- pieces


def test_parity_and_round_trip(spark):
    codec = PieceCodec.at(PIECES, 1)
    words = [p.replace("▁", " ") for p, _, k in codec.model.pieces[3000:9000:7] if k == 1]
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(words) for _ in range(80)) for _ in range(40)]
    want = codec.sentencepiece.encode(texts)
    assert codec.encode(texts) == want
    for _ in range(2):
        ids, agree = codec.encode_checked(texts)
        assert [x.tolist() for x in ids] == want and all(agree)
    # a mark in the text itself decodes to a blank in both libraries
    assert codec.decode(want) == [codec.sentencepiece.decode(x) for x in want] == [t.replace("▁", " ") for t in texts]
    df = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, None, 1)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in encode_pieces(df, PIECES).collect()}
    assert len(got) == len(texts) + 1 and got[None]["n_tokens"] == 0
    for i, ids in enumerate(want):
        assert got[i]["ids"] == ids and got[i]["round_trip"] == ("▁" not in texts[i]) and got[i]["parity"] and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
    assert encode_pieces(df.where("doc_id < 0"), PIECES).count() == 0


def message(*fields):
    """A protobuf message of (number, value): bytes, whole numbers, or 32-bit floats."""
    out = b""

    def varint(n):
        part = b""
        while n > 127:
            part += bytes([n & 127 | 128])
            n >>= 7
        return part + bytes([n])

    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_file(path, fallback, normaliser, user=()):
    """A small unigram model, built by hand: special pieces, bytes, pieces of words and characters with scores."""
    rng = random.Random(13)
    text = {"▁the", "the", "▁sea", "sea", "▁s", "ea", "▁a", "b", "and", "▁and", "▁sand", "<s", "s>", "0x4", "x41", "é", "▁café", "caf", "日本", "本", "ﬁ"}
    text |= {"▁" + "".join(rng.choice("aebnst") for _ in range(rng.randrange(1, 6))) for _ in range(150)} | {"".join(rng.choice("aebnst") for _ in range(2)) for _ in range(40)}
    chars = {c for p in text for c in p} | set("<>0x41s▁ .,")- {" "}
    normal = sorted(text | chars - {"é"})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("spare", -1.0, 5), *((u, 0.0, 4) for u in user)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [(p, -2.0 - 9 * rng.random() - (3 if len(p) == 1 else 0), 1) for p in normal if p not in user]
    trainer = message((3, 1), *([(35, 1)] if fallback else []), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    norm = message((1, b"own"), (3, 1), (4, 0), (5, 1))
    if normaliser:
        inner = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        spec = next(v for n, v in fields_of(inner) if n == 3)
        norm = message((1, b"nmt_nfkc"), (2, next(v for n, v in fields_of(spec) if n == 2)), (3, 1), (4, 1), (5, 1))
    path.write_bytes(message(*[(1, message((1, p.encode()), (2, s), *([(3, k)] if k != 1 else []))) for p, s, k in pieces], (2, trainer), (3, norm)))
    return str(path)


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("normaliser", [False, True])
def test_unigram_parity(spark, tmp_path, fallback, normaliser):
    """Unigram scores, byte fallback and normaliser against sentencepiece, with texts that spell control and byte pieces."""
    path = unigram_file(tmp_path / "u.model", fallback, normaliser)
    rng = random.Random(3)
    texts = [*ODD, "a <s> b", "</s>", "the<0x41>sea", "<unk> spare spared", "<0x41><0x42>", "café ﬁ 日本本 zzz", "q" * 50, "the sea and the sand " * 40, "Ａ① the"]
    texts += ["".join(rng.choice(["the ", "sea", " and", "<s>", "<0x4", "1>", "é", "Z", "日", "  ", "a", "bt", "ne", "sta", "ﬁ"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    codec = PieceCodec(path, 2)
    assert codec.model.kind == 1 and codec.encode(texts) == codec.sentencepiece.encode(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, want in enumerate(codec.sentencepiece.encode(texts)):
        assert got[i]["ids"] == want and got[i]["parity"], texts[i]
        if fallback and not normaliser:
            assert got[i]["round_trip"] == ("▁" not in texts[i]), texts[i]


def test_user_defined_pieces(tmp_path):
    codec = PieceCodec(unigram_file(tmp_path / "d.model", False, False, ("sea", "<x>")), 1)
    texts = ["the sea", "<x>seasea", "thesea <x> a", "a<x", "sand"]
    assert codec.encode(texts) == codec.sentencepiece.encode(texts)


def test_very_long_and_repeated_texts(spark):
    long = "word " * 400_000 + "x" * 300_000
    df = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, "word", "c")], "doc_id long, text string, parity string")
    got = encode_pieces(df, PIECES, keep_ids=False).collect()
    assert len(got) == 3 and all(r["round_trip"] and r["parity"] is True for r in got)
    want = PieceCodec.at(PIECES, 1).sentencepiece.encode(long)
    assert {r["ids_crc32"] for r in got if r["doc_id"] == 1} == {zlib.crc32(np.array(want, "<u4"))}


# ---- classifier


def marked(n=500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdef") for _ in range(60)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".\n"
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 5}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


SCHEMA, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = marked()
    odd = [(9000, None, None, None, None), (None, "", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(labels + [(2, None, 0), (None, 1, 0)], LABELS)
    got = {r["doc_id"]: r for r in score_quality(docs, marks).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got.values())
    unseen = [i for i in range(500) if i % 2]
    assert np.mean([got[i]["keep"] == (i % 4 != 0) for i in unseen]) > 0.98
    kept = keep_quality(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    """Views exchange rows that have no label; the rounds change the model, and reruns agree."""
    rows, labels = marked()
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels[:40], LABELS)
    given = []
    give = cotraining.CoTraining.give
    monkeypatch.setattr(cotraining.CoTraining, "give", lambda self, view, row, label: (given.append((view, label)), give(self, view, row, label)))
    once = fit_quality(docs, marks, rounds=2)
    n = len(given)
    assert {v for v, _ in given} == {0, 1} and {l for _, l in given} == {0, 1} and n <= 2 * 2 * (cotraining.GIVEN_ROWS + 1)
    again = fit_quality(docs.repartition(2), marks, rounds=2)
    assert np.allclose(once.text.weights, again.text.weights, atol=1e-6) and len(given) == 2 * n
    alone = fit_quality(docs, marks, rounds=0)
    assert len(given) == 2 * n and not np.allclose(alone.text.weights, once.text.weights)


def test_clashing_columns_long_and_repeated_rows(spark):
    rows, labels = marked(200)
    rows += [(7, rows[7][1], "en", "s1", 3), (7, "OTHER!! " * 30, None, None, None), (9001, "alphaa betab. " * 150_000, "en", "s1", 1)]
    names = SCHEMA + ", score double, keep string, _0 int, layout string, `a.b` int"
    docs = spark.createDataFrame([(*r, 0.5, "k", 1, "l", 2) for r in rows], names)
    marks = spark.createDataFrame([(*r, 9.0) for r in labels], LABELS + ", text double")
    scored = score_quality(docs, marks).collect()
    assert len(scored) == len(rows) and next(r for r in scored if r["doc_id"] == 9001)["keep"]
    kept = keep_quality(docs, marks)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() == sum(r["keep"] for r in scored) and kept.first()["a.b"] == 2
    assert keep_quality(docs.limit(0), marks).count() == 0 and keep_quality(docs, marks.limit(0)).columns == docs.columns


def test_without_labels_everything_stays(spark):
    rows, labels = marked(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    for marks in ([], [(i, 1, 0) for i in range(30)]):
        got = score_quality(docs, spark.createDataFrame(marks, LABELS)).collect()
        assert len(got) == 40 and all(r["keep"] and r["score"] is None for r in got)
    assert score_quality(docs.where("doc_id < 0"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_text_view_counts_trigrams():
    x = text_view([b"abcabc", b"", b"ab", b"abcabc"])
    assert x.shape == (4, TEXT_DIMS) and (x[0] == x[3]).all() and x[1, :TRIGRAMS].sum() == 0 and (x[0, :TRIGRAMS] > 0).sum() == 3
    rng = random.Random(1)
    long = bytes(rng.choice(b"abcdef \n") for _ in range(5000))
    naive = collections.Counter((int.from_bytes(long[i : i + 3]) * 2654435761 % 2**32) >> 21 for i in range(len(long) - 2))
    for size in (1 << 20, 700):  # in one piece, and cut into pieces
        cotraining.PIECE = size
        assert {i: int(n) for i, n in enumerate(trigrams(long)) if n} == naive
    cotraining.PIECE = 1 << 20


def test_distinct_words_over_the_whole_text():
    clean = [b"w%d" % i for i in range(2000)]
    loop = [b"spam"] * 6000
    texts = [b" ".join(x) for x in (clean, clean + loop, loop + clean, loop, clean * 4, clean[:10])] + [b""]
    fresh = text_view(texts)[:, TRIGRAMS] / 255
    assert np.allclose(fresh, [1, 2003 / 8000, 2003 / 8000, 3 / 6000, 1, 1, 1], atol=2e-3)
