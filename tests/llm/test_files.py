"""WARC archives, media files and token shards: round trips and odd input."""

import base64
import collections
import gzip
import hashlib
import io
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import progressive_jpeg as pj
from skyloom.llm import warc
from skyloom.llm.media import encode_media, jpeg_to_payload, media_digests, media_tensors, padded, payload_to_jpeg, picture_feature
from skyloom.llm.repair import LEAST, Shard, pack_shard, read_documents, read_token_shards, repair, write_token_shards
from skyloom.llm.subwords import WordCachedTokenizer
from skyloom.session import shared_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "\n\n \t", "é ñ ß", "The the THE, don't we'll x_y _ 12ab ² Ⅷ", "İstanbul Σας ΣΑΣ", "a<|endoftext|>b <|ENDOFTEXT|>", "日本語、テスト。", "q\x1cr \x85 z", "x" * 5000, "étude á, ﬁ ẞ!", "word " * 3000]


# ---- WARC


def test_warc_round_trip(spark):
    warc.register(spark)
    rows = [(i, f"http://h/{i}", ("dup" if i % 3 == 0 else f"<p>{i} é\r\n\r\nWARC/1.1</p>")) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "dup"), (60, "x\ny: z", "one")]
    folder = shared_path(spark, "t-warc")
    warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    got = {r["page_id"]: r for r in warc.archived_pages(back).collect()}
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if i == largest[h or ""]:
            assert r["record_type"] == "response" and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == largest[h or ""]
    some = back.where("record_type = 'revisit' and target_uri in ('http://h/3', 'http://h/6', 'http://h/1')")
    assert sorted(r["target_uri"] for r in some.collect()) == ["http://h/3", "http://h/6"]
    bare = spark.read.format("warc").option("payloads", "false").load(folder)
    assert bare.where("payload is not null").count() == 0 and bare.where("record_type <> 'warcinfo'").count() == len(rows)
    # plain and unindexed archives, and ranges of an indexed one, give the same records
    whole = {(r["record_id"], r["record_type"], bytes(r["payload"] or b"")) for r in spark.read.format("warc").load(folder).collect()}
    plain, loose = shared_path(spark, "t-warc"), shared_path(spark, "t-warc")
    for target in (plain, loose):
        Path(target.removeprefix("file:")).mkdir(parents=True)
    for f in Path(folder.removeprefix("file:")).glob("*.warc.gz"):
        Path(loose.removeprefix("file:"), f.name).write_bytes(f.read_bytes())
        Path(plain.removeprefix("file:"), f.stem).write_bytes(gzip.decompress(f.read_bytes()))
        parts = [warc.FilePart(folder, str(f), f.stat().st_size, a, b, True) for a, b in ((0, 200), (200, 201), (201, 10**9))]
        read = [r for p in parts for r in warc.WarcReader({"path": folder}).read(p)]
        assert {(r[0], r[1], r[10] or b"") for r in read} <= whole and len(read) == len(list(warc.WarcReader({"path": folder}).read(warc.FilePart(folder, str(f), 0, 0, 0, False))))
    for target in (plain, loose):
        load = lambda: spark.read.format("warc").load(target)  # noqa: B023, E731
        frame = load()
        assert {(r["record_id"], r["record_type"], bytes(r["payload"] or b"")) for r in frame.collect()} == whole
        assert load().where("record_type = 'revisit'").count() == sum(k == "revisit" for _, k, _ in whole)
    # overwriting puts new archives in the place of old ones
    again = spark.createDataFrame([(1, "u", "z" * 300_000, "clash", 5)], "page_id long, url string, html string, payload string, hex int")
    warc.with_revisits(again).write.format("warc").mode("overwrite").save(loose)
    left = spark.read.format("warc").load(loose).where("record_type = 'response'").collect()
    assert [len(r["payload"]) for r in left] == [300_000]
    assert sum(p.name.endswith(".tmp") for p in Path(loose.removeprefix("file:")).iterdir()) == 0
    empty = shared_path(spark, "t-warc")
    warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(empty)
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_filters_are_pushed_and_payloads_passed_over():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = warc.WarcReader({"path": "/nowhere"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), IsNotNull(("record_id",)), GreaterThan(("offset",), 3), EqualTo(("offset",), 3)]))
    assert len(left) == 2
    assert reader.wanted({"warc-type": "response", "warc-target-uri": "a", "warc-record-id": "1"}) and not reader.wanted({"warc-type": "revisit"})
    records = [warc.record_bytes(k, {"WARC-Record-ID": f"<{i}>", "WARC-Target-URI": f"u{i}"}, b"x" * i) for i, k in enumerate(["warcinfo", "response", "response", "revisit"])]
    data = b"".join(records)
    got = list(warc.parse_records(io.BytesIO(data), lambda f: f["warc-type"] == "response"))
    assert [(o, b) for o, _, b in got] == [(len(records[0]), b"x"), (len(records[0]) + len(records[1]), b"xx")]
    assert [b for _, _, b in warc.parse_records(io.BytesIO(data), payloads=False)] == [None] * 4
    assert [(o, b) for o, _, b in warc.parse_records(io.BytesIO(data), lambda f: f["warc-type"] == "response", size=len(data))] == [(len(records[0]), b"x"), (len(records[0]) + len(records[1]), b"xx")]
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(data[:-9]), lambda f: False, size=len(data) - 9))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            found = super().read(n)
            Counted.taken += len(found)
            return found

    big = [gzip.compress(warc.record_bytes(k, {"WARC-Record-ID": f"<{i}>", "X-Long": "h" * 9000}, random.Random(i).randbytes(500_000))) for i, k in enumerate(["response", "revisit", "response"])]
    at = np.cumsum([0, *map(len, big)])[:-1]
    spans = np.stack([at, [len(b) for b in big]], axis=1)
    found = list(warc.parse_members(Counted(b"".join(big)), spans, lambda f: f["warc-type"] == "revisit"))
    assert len(found) == 1 and found[0][2] == random.Random(1).randbytes(500_000) and Counted.taken < 520_000
    members = b"".join(gzip.compress(r) for r in records)
    assert len(list(warc.parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(members)))))) == 4
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(data[:-9])))


# ---- progressive JPEG


def sparse(rng, rows, cols, p):
    x = rng.integers(-40, 41, (rows, cols, 64)).astype(np.int16)
    x[rng.random((rows, cols, 64)) > p] = 0
    return x


@pytest.mark.parametrize("p", [0.0, 0.02, 0.3, 0.9, 1.0])
def test_scans_of_any_structure(p):
    rng = np.random.default_rng(int(p * 100))
    for factors in (((2, 2), (1, 1), (1, 1)), ((1, 1),), ((2, 1), (1, 1), (1, 1))):
        comps = [pj.Component(h, v, sparse(rng, 3 * v, 2 * h, p)) for h, v in factors]
        h, v = factors[0]
        image = pj.Image(16 * h, 24 * v, comps, {0: np.full(64, 3)}, b"note")
        back = pj.read_progressive(pj.write_progressive(image))
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(image.components, back.components))
        assert back.comment == b"note" and (back.quant[0] == 3).all()
        assert pj.to_rgb(back).shape == (24 * v, 16 * h, 3)


def test_transform_and_colours():
    grey = pj.Image(8, 8, [pj.Component(1, 1, np.zeros((1, 1, 64), np.int16))], {0: np.ones(64)})
    grey.components[0].coefficients[0, 0, 0] = 8 * 50
    assert (pj.to_rgb(grey) == 178).all()
    basis = pj.BASIS.astype(np.float64)
    assert np.allclose(basis @ basis.T, np.eye(64), atol=1e-6) and sorted(pj.ZIGZAG.tolist()) == list(range(64)) and pj.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    red = pj.Image(16, 16, [pj.Component(2, 2, np.zeros((2, 2, 64), np.int16)), *(pj.Component(1, 1, np.zeros((1, 1, 64), np.int16)) for _ in "bc")], {0: np.ones(64)})
    red.components[2].coefficients[0, 0, 0] = 8 * 100
    r, g, b = pj.to_rgb(red)[9, 3]
    assert (int(r), int(b)) == (255, 128) and int(g) == 128 - round(0.714136 * 100)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(data):
    whole = padded(data)
    assert len(whole) % 576 == 0 and len(whole) >= 576 and whole.startswith(data)
    assert jpeg_to_payload(pj.read_progressive(payload_to_jpeg(whole))) == whole


def test_media_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "z" * 576, None)], "doc_id long, text string, media string")
    media = encode_media(df).cache()
    got = {r["doc_id"]: r for r in media_digests(media).collect()}
    for i, t in [*enumerate(ODD), (None, "z" * 576)]:
        whole = padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-32:])
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    assert all(got[i]["media_bytes"] == len(f) and got[i]["media_sha256"] == hashlib.sha256(f).hexdigest() for i, f in stored.items())
    assert got[0]["feature"] == got[1]["feature"]
    t = media_tensors(media).first()
    assert len(t["rgb"]) == 3 * t["height"] * t["width"] and t["height"] % 16 == 0
    assert encode_media(df.where("doc_id > 99")).count() == 0


def test_feature_by_plain_loops():
    rng = np.random.default_rng(3)
    for h, w in ((16, 16), (32, 48)):
        rgb = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        grey = [[sum(int(v) for v in rgb[y, x]) for x in range(w)] for y in range(h)]
        total, bits = sum(map(sum, grey)), ""
        for i in range(8):
            for j in range(8):
                cell = [grey[y][x] for y in range(i * h // 8, (i + 1) * h // 8) for x in range(j * w // 8, (j + 1) * w // 8)]
                bits += str(int(sum(cell) * h * w > total * len(cell)))
        means = [sum(int(rgb[y, x, c]) for y in range(h) for x in range(w)) // (h * w) for c in range(3)]
        assert picture_feature(rgb) == f"{int(bits, 2):016x}" + "".join(f"-{m}" for m in means)


def test_very_long_repeated_and_clashing_media(spark):
    long = "0123456789abcdef" * 200_000
    df = spark.createDataFrame([(1, long, b"x", 7), (1, long, b"y", 8), (2, "short", None, None)], "doc_id long, text string, media binary, n_bytes int")
    got = media_digests(encode_media(df)).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    whole = padded(long.encode())
    r = next(r for r in got if r["doc_id"] == 1)
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(long), len(whole), hashlib.sha256(whole).hexdigest())


# ---- token shards


def test_cached_words_equal_whole_texts():
    for path, prefix in ((WORDS, ""), (BYTES, " ")):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = bool(prefix)
        texts = [*(t or "" for t in ODD), "The CAT, <|endoftext|> Ab", "a<|b É Ab!", "  two  \n\t three\x0b\x0cfour "]
        if prefix:
            want = [[i for w in t.encode().lower().split() for i in tokenizer.encode(prefix + w.decode(), add_special_tokens=False).ids] for t in texts]
        else:
            want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            assert [a.tolist() for a in WordCachedTokenizer.at(path, prefix).ids([t.encode() for t in texts])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([10, 70_000]))
def test_repair_round_trip(docs, first):
    arrays = [np.array(d, np.uint32) for d in docs]
    shard = Shard(pack_shard([None, *range(1, len(docs))], arrays, 5, first))
    assert shard.all_ids().tolist() == [x for d in docs for x in d] and shard.before == 5
    assert all(shard.document(i).tolist() == d for i, d in enumerate(docs))


def test_repair_shrinks_and_keeps_documents_apart():
    ids = np.array([1, 2, 3] * 200 + [9], np.uint32)
    symbols, ends, rules = repair(ids, np.array([301, 601]), 10)
    assert len(symbols) < 300 and len(rules) and ends[-1] == len(symbols)
    many = np.random.default_rng(2).integers(0, 300, 200_000).astype(np.uint32)
    for ids, stops in ((many, np.array([90_000, 200_000])), (np.full(5000, 7, np.uint32), np.array([5, 5000])), (np.tile([4, 4, 4, 5, 4], 900).astype(np.uint32), np.array([4500]))):
        symbols, ends, rules = repair(ids, stops, 300)
        pairs = collections.Counter()
        for a, b in zip([0, *ends], ends):
            own, k = symbols[a:b].tolist(), 0
            for x, y in zip(own, own[1:]):
                k = k + 1 if x == y else 0  # overlapping pairs of a run count once
                pairs[x, y] += x != y or k % 2
        assert max(pairs.values()) < LEAST and len(rules) > (5000 if len(ids) == 200_000 else 3)
        shard = Shard(pack_shard(list(range(len(stops))), np.split(ids, stops[:-1]), 0, 300))
        assert (shard.all_ids() == ids).all() and shard.lengths.max() <= len(ids)
    with pytest.raises(ValueError):
        Shard(b"NOPE" + b"\0" * 60)


def test_token_shards(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "δέλτα"]) for _ in range(rng.randrange(200)))) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "nobody"), (5, "again"), (5, "again")]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string")
    manifest = write_token_shards(df, shared_path(spark, "t-rpr"), WORDS, 1, 49408, shard_ids=2000)
    got = sorted(read_token_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    tokenizer, at = Tokenizer.from_file(WORDS), 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        sums = {zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")) for t in texts[r["doc_id"]]}
        assert r["ids_crc32"] in sums
    assert manifest.where("n_docs > 0").count() > 3
    some = read_documents(manifest, [7, 1002, 5, 99_999]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 5, 5, 7, 1002]
    assert all(r["ids"][:-1] in [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]] and r["ids"][-1] == 1 for r in some)
    assert read_documents(manifest, []).count() == 0
    long = "alpha beta, " * 150_000
    odd = spark.createDataFrame([(3, long, 1, "x", 2), (1, None, 2, "y", 3), (3, long, 1, "x", 2)], "doc_id long, text string, part int, file string, at int")
    big = sorted(read_token_shards(write_token_shards(odd, shared_path(spark, "t-rpr"), WORDS, 1, 49408)).collect(), key=lambda r: r["start"])
    want = [*tokenizer.encode(long, add_special_tokens=False).ids, 1]
    assert [r["n_tokens"] for r in big] == [1, len(want), len(want)] and big[2]["ids_crc32"] == zlib.crc32(np.array(want, "<u4"))
    none = write_token_shards(df.where("doc_id = -1"), shared_path(spark, "t-rpr"), WORDS, 1, 49408)
    assert read_token_shards(none).count() == 0
