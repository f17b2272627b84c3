"""Chat windows against a plain re-reading of the conversations; divergence of sources against counts in Python."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyloom.llm import queries
from skyloom.llm.chat import SHUT, chat_digests, chat_windows, token_counts, window_turns
from skyloom.llm.divergence import source_divergence

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows):
    """Turns of each conversation: null turns first, then by role and MD5 of the text."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        found[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: [(r[2], r[4]) for r in sorted(rs)] for c, rs in found.items()}


def digests(rows):
    out = {}
    for conv, turns in ordered(rows).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
    return out


def found(spark, rows, **options):
    windows = chat_windows(spark.createDataFrame(rows, TURNS), BPE, **options)
    return windows, {r[0]: tuple(r)[1:5] for r in chat_digests(windows).collect()}


ODD = [
    (1, 0, "system", "Be <turn brief>."), (1, 1, "user", "a </turn>\n b"), (1, 2, "assistant", r"\l \b \\ <turn"), (1, 3, "user", ""), (1, 4, "assistant", ""),
    (2, 0, "assistant", "only"), (3, 0, None, None), (3, None, "user", "first"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
    (None, 1, "user", "of no one"), (None, 2, "assistant", "answer of no one"), (4, 0, "a>b\n<c\\", "x>\ny"), (5, 0, "user", "long " * 9000), (5, 1, "assistant", "long é𝄞 " * 9000),
    (6, 0, "system", "rules " * 500), (6, 1, "user", "u"), (6, 2, "assistant", "v"), (7, 0, "user", "x"), (7, 1, "system", "late"), (7, 2, "assistant", "z\U0001f600"),
]


def test_odd_turns_come_back(spark):
    _, got = found(spark, ODD, budget=64, history=16)
    assert got == digests(ODD)


def many(n=3000):
    """One conversation with most turns, among short ones."""
    rows = [(9, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 40)) for i in range(n)]
    return rows + [(100 + i // 4, i % 4, ("user", "assistant")[i % 2], f"short {i}") for i in range(n // 4)]


@pytest.fixture(scope="module")
def cut(spark):
    rows = many()
    windows, got = found(spark, rows, budget=200, history=60)
    return rows, windows, got


def test_a_conversation_over_many_ranges(cut):
    rows, _, got = cut
    assert got == digests(rows)


def test_windows_hold_to_the_budget(cut):
    rows, windows, _ = cut
    turns, seen = ordered(rows), defaultdict(int)
    cost = lambda r, t: int(token_counts([f"<turn {r}>\n{t}{SHUT}"], BPE)[0])
    repeated = 0
    for w in sorted(window_turns(windows).collect(), key=lambda w: (w.conv_id, w.window)):
        own, at = turns[w.conv_id], seen[w.conv_id]
        assert w.first_turn == at  # gapless: each turn is new once, in order
        new = [(t.role, t.text) for t in w.turns if not t.repeated]
        old = [(t.role, t.text) for t in w.turns if t.repeated]
        assert new == own[at : at + w.n_new]
        assert old[w.n_retained :] == own[at - w.n_repeated : at] if w.n_repeated else len(old) == w.n_retained
        if own[0][0] == "system" and at:
            assert old[0] == own[0]
        assert w.learnt == [t for r, t in new if r == "assistant"]
        assert sum(cost(r, t) for r, t in new + old) <= 200
        assert sum(cost(r, t) for r, t in old[w.n_retained :]) <= 60
        assert [w.text[s.start : s.start + s.chars] for s in w.loss] == w.learnt  # nothing here is escaped
        seen[w.conv_id] += w.n_new
        repeated += w.n_repeated
    assert dict(seen) == {c: len(t) for c, t in turns.items()}
    assert repeated > 100


def test_tokens_of_pieces_add_up(cut):
    _, windows, _ = cut
    for w in windows.where("conv_id = 9").limit(20).collect():
        parts = [x + SHUT for x in w.text.split(SHUT)[:-1]]
        assert token_counts([w.text], BPE)[0] == token_counts(parts, BPE).sum()


def test_layout_does_not_matter(spark, cut):
    rows, windows, _ = cut
    again = chat_windows(spark.createDataFrame(rows, TURNS).repartition(7), BPE, budget=200, history=60)
    assert sorted(map(str, windows.collect())) == sorted(map(str, again.collect()))


def test_no_conversations_and_clashing_names(spark):
    empty = chat_windows(spark.createDataFrame([], TURNS), BPE)
    assert empty.count() == 0 and chat_digests(empty).count() == 0
    more = spark.createDataFrame(ODD, TURNS).withColumns({c: F.lit(1) for c in ("key", "n", "loss", "window", "TEXT2")})
    clash = more.toDF(*more.columns[:-1], "Text")
    assert {r[0]: tuple(r)[1:5] for r in chat_digests(chat_windows(clash, BPE)).collect()} == digests(ODD)


def test_registered_query_reads_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = queries.op11_budgeted_windows(spark, SF)
    assert dict(got.dtypes) == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint", "n_windows": "bigint"}
    assert {r[0]: tuple(r)[1:5] for r in got.collect()} == digests(rows)


# ---- divergence of sources


def divergence(rows, least=10, top=10):
    docs = [(text or "", lang or "", source or "") for text, lang, source in rows]
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(small)), lang, s) for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(t for ts, la, _ in terms if la == lang for t in set(ts))
        kept = {t for t, c in df.items() if c >= least}
        sources = sorted({s for _, la, s in docs if la == lang}, key=lambda s: s.encode())
        counts = {s: Counter(t for ts, la, x in terms if la == lang and x == s for t in ts if t in kept) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, held, limit in (("pair", pairs, None), ("term", own, top)):
                order = sorted(held, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


TEXTS = "text string, lang string, source string"


def spread(spark, rows, **options):
    return sorted(tuple(r) for r in source_divergence(spark.createDataFrame(rows, TEXTS), **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_sources_against_counts(spark):
    rows = [(" ".join(f"w{'abcdefgh'[(i * j + k) % 8]}É" for k in range(i % 13)) + " The THE the", ("en", "de", None)[i % 3], ("a", "b", "ß", None)[i * i % 4]) for i, j in [(i, i % 7) for i in range(300)]]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("rare words", "yy", "p"), (None, "yy", "q"), ("tie one two", "en", "z")] + [("same same row", "en", "a")] * 30
    assert spread(spark, rows) == divergence(rows)
    assert spread(spark, rows, min_docs=3, top_terms=2) == divergence(rows, 3, 2)


def test_one_source_with_most_rows_and_a_long_text(spark):
    rows = [("alpha beta " * 20, "en", "hot")] * 400 + [("gamma beta", "en", f"s{i % 5}") for i in range(40)] + [("long " * 50000 + "alpha", "en", "s1")] * 10
    assert spread(spark, rows) == divergence(rows)


def test_no_documents_and_clashing_divergence_names(spark):
    assert source_divergence(spark.createDataFrame([], TEXTS)).count() == 0
    rows = [("one two", "en", "a")] * 12 + [("two", "en", "b")] * 3
    df = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("x") for c in ("term", "n", "p", "q", "part", "rank", "other", "TEXT2")})
    df = df.toDF(*df.columns[:-1], "Text")
    got = sorted(tuple(r) for r in source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == divergence(rows)


def test_large_counts_stay_exact(spark):
    from skyloom.llm.divergence import share

    n = 9_000_000_000_000_000
    df = spark.createDataFrame([(n, n * 100, 7)], "n long, total long, kept long")
    assert df.select(share("n", "total", "kept")).first()[0] == 1 + 10**9 * (n + 2) // (n * 100 + 14)
