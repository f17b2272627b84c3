"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from skyloom.llm import near_dedup, skew
from skyloom.llm.arrays import shingles, word_hashes
from skyloom.llm.near_dedup import bands_for, keep_representatives, near_duplicates, superminhash


def word_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, percent):
    sets = word_sets([t for _, t in rows], k)
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None in (ids[a], ids[b]) or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, [len(s) for s in sets]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 40, 120]))) for _ in range(30)]
    texts = list(base)
    for b in base[:12]:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    hub = [rng.choice(words) for _ in range(150)]
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["", None, "   \n", "one", "ONE", "one two", base[0].upper(), base[0], "é É", "x " * 5000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent,hot", [(1, 3, 85, 256), (2, 5, 80, 256), (1, 3, 85, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, k, percent, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", max(4, hot // 4))
    rows = corpus(seed) + [(None, "alone with no id"), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want, sizes = brute(rows, k, percent)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None} == {i: i == c for i, c in want.items()}
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    size = {i: n for (i, _), n in zip(rows, sizes) if i is not None}
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == size


def test_two_copies_among_holders_of_one_passage(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join(passage + [f"t{rng.randrange(10**9)}" for _ in range(60)])) for i in range(80)]
    for i, at in ((900, 60), (901, 130)):
        rows.append((i, " ".join(passage[:at] + ["other"] + passage[at + 1 :])))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 3, 85)[0]
    assert sum(not r["kept"] for r in got) == 1


def test_empty_repeated_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rep string")
    assert near_duplicates(empty).count() == 0 and keep_representatives(empty).count() == 0
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "y"), (3, "other words here and there now", "z"), (None, text, "n")]
    kept = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, members string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "members"]


def test_different_texts_of_one_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    near = texts[1].replace("b29", "other")
    rows = [(5, texts[0], "1"), (5, texts[1], "2"), (5, texts[1], "2"), (7, near, "3"), (None, texts[2], "4"), (None, texts[2], "5"), (None, near, "6"), (8, texts[3], "7"), (9, None, "8"), (9, None, "9"), (None, "", "10")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _node string, _row int, component_id int")
    got = [keep_representatives(d).collect() for d in (df, df.repartition(3))]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in got[0]) == sorted([(texts[0], 5), (texts[1], 5), (texts[2], 0), (texts[3], 8), ("", 9), ("", 9), ("", 0)])
    assert got[0][0].asDict().keys() == set(df.columns)


def test_hot_keys_join_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1 if i < 500 else i, i) for i in range(700)], "key long, id long")
    table = spark.createDataFrame([(k, k * 2) for k in (1, 600, 601, 9999)], "key long, twice long")
    assert sorted((r["id"], r["twice"]) for r in skew.salted_join(rows, table, ["key"], "id").collect()) == [(i, 2) for i in range(500)] + [(600, 1200), (601, 1202)]
    left = skew.salted_join(rows, table, ["key"], "id", "left").collect()
    assert len(left) == 700 and sum(r["twice"] is None for r in left) == 198


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = pool[:200], pool[60:260]
        true = 140 / 260
        sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 128)
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (true * (1 - true) / 128) ** 0.5
    # stopping early does not change a signature
    one = superminhash(np.arange(5000, dtype=np.uint64), np.zeros(5000, np.int64), 1, 64)
    two = superminhash(np.arange(5000, dtype=np.uint64)[::-1].copy(), np.zeros(5000, np.int64), 1, 64)
    assert (one == two).all() and (superminhash(np.arange(3, dtype=np.uint64), np.zeros(3, np.int64), 1, 64) < 64 << 32).all()
    assert (1 - 0.8**5) ** bands_for(80) <= 1e-6


def test_word_hashes_chunks_and_limits():
    long = b"word " * 300_000
    h, n = word_hashes([long])
    assert n[0] == 300_000 and len(set(h.tolist())) == 1
    h, n = word_hashes([b"", b" a\tb\nc\x0b\x0cd\re ", b"\xc2\xa0x"])
    assert n.tolist() == [0, 5, 1]
    s, n = shingles([b"a b c d", b"A B C D", b"a b", b""], 3)
    assert n.tolist() == [2, 2, 1, 0] and s[:2].tolist() == s[2:4].tolist()


@pytest.mark.parametrize("percent", [80, 100])
def test_rest_blocks_by_size_classes(spark, monkeypatch, percent):
    """One open group of sets of all sizes: the links join what comparing all pairs joins."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(percent)
    sets = {}
    for i in range(150):
        base = rng.choice(4000, rng.integers(4, 300), replace=False)
        for j in range(rng.integers(1, 4)):
            keep = base[: max(1, len(base) - rng.integers(0, max(1, len(base) // 4) + 1))]
            sets[1000 * i + j] = np.unique(np.concatenate([keep, rng.integers(4000, 4100, rng.integers(0, 3))])).astype(np.int64)
    sets |= {900_001: np.arange(80), 900_002: np.arange(100), 900_003: np.arange(64)}  # just at the threshold
    rows = [(7, i, i, len(x)) for i, x in sets.items()]
    open_ = spark.createDataFrame(rows, "bucket long, rep long, part long, n long")
    members = spark.createDataFrame([(i, x.tolist()) for i, x in sets.items()], "doc_id long, members array<long>")
    links = [(r["a"], r["b"]) for r in near_dedup._rest_links(open_, members, percent).collect()]
    like = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
    assert all(like(a, b) for a, b in links)
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and like(a, b)}
    linked = lambda edges: {frozenset(c) for c in _groups(sets, edges)}
    assert linked(links) == linked([tuple(p) for p in want]) and want


def _groups(nodes, edges):
    at = {i: {i} for i in nodes}
    for a, b in edges:
        if at[a] is not at[b]:
            at[a] |= at[b]
            for x in at[b]:
                at[x] = at[a]
    return {id(g): g for g in at.values()}.values()
