"""Conversations as training windows of a token budget, with loss masks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.arrays import exactly, runs, small_batches
from skyloom.llm.skew import salted_join
from skyloom.session import staged, unstage

#: Marks of the template. Texts hold neither "<turn" nor "</turn" once they are escaped.
OPEN, SHUT = "<turn ", "</turn>\n"
SYSTEM, TARGET = "system", "assistant"
#: Bytes of text that the tokenizer gets at a time.
RUN_BYTES = 1 << 20
# kinds of pieces, in the order that they have in a window
RETAINED, REPEATED, NEW = 0, 1, 2


def escape(text: Column) -> Column:
    r"""Backslashes become \b and the brackets of control strings \l, so that an order of two plain replacements undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<turn"), F.lit("\\lturn")), F.lit("</turn"), F.lit("\\l/turn"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As texts, and without what ends the mark: brackets and line ends."""
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(F.replace(role, F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # what texts spell is text
    return found


def token_counts(texts: list[str], path: str) -> np.ndarray:
    """Ids that a tokenizer file gives each text."""
    out, sizes = [], [t.encode() for t in texts]
    for i, j in runs(sizes, RUN_BYTES):
        out += [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts[i:j], add_special_tokens=False)]
    return np.array(out, np.int64)


def numbered_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Turns in the order of their conversation, with place, tokens, and tokens before them: written.

    A conversation may be most of the table, so turns are sorted by ranges that
    may cut it. Each range adds up its own part; what the parts before hold is
    added from a table of the conversations that are cut, two rows for each
    range at most. ``lead`` is the size of the conversation's system turn,
    which stands before all windows and so counts for none.
    """
    spark = conversations.sparkSession
    own = exactly(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    keyed = own.select(key.alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["key", "turn", "role", F.md5("text"), "row"]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shown = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"), escape(F.col("text")), F.lit(SHUT))
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "conv_id", "role", "text", shown.alias("shown"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, n, before, lead = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = token_counts(batch["shown"].to_pylist(), tokenizer)
            keys = batch["key"].to_pylist()
            fresh = np.array([a != b for a, b in zip(keys, [last, *keys], strict=False)])
            starts = np.flatnonzero(np.concatenate([[True], fresh[1:]]))
            upto = np.cumsum(tokens) - tokens
            sizes = np.diff(np.append(starts, len(keys)))
            place, ahead = np.arange(len(keys)) - np.repeat(starts, sizes), upto - np.repeat(upto[starts], sizes)
            roles = [batch["role"][int(i)].as_py() for i in starts]
            leads = np.array([t if r == SYSTEM else 0 for r, t in zip(roles, tokens[starts], strict=True)], np.int64)
            if not fresh[0]:  # goes on from the batch before
                place[: sizes[0]] += n
                ahead[: sizes[0]] += before
                leads[0] = lead
            last, n, before, lead = keys[-1], int(place[-1]) + 1, int(ahead[-1] + tokens[-1]), int(leads[-1])
            numbers = [place.astype(np.int64), tokens, ahead, np.repeat(leads, sizes)]
            columns = [batch[c] for c in ("key", "conv_id", "role", "text")] + [pa.array(x, pa.int64()) for x in numbers] + [pa.array(np.full(len(keys), block, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "conv_id", "role", "text", "n", "tokens", "before", "lead", "block"])

    kind = own.schema["conv_id"].dataType.simpleString()
    numbered = small_batches(dealt).mapInArrow(number, f"key string, conv_id {kind}, role string, text string, n long, tokens long, before long, lead long, block int")
    return staged(numbered, "turns", compression="zstd")


def _cut_conversations(turns: DataFrame) -> DataFrame:
    """What the parts before each part of a cut conversation hold: key, block, turns, tokens, lead of the whole."""
    parts = turns.groupBy("key", "block").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.max("lead").alias("lead"))
    cut = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "turns", "tokens", "lead"))).alias("parts")).where(F.size("parts") > 1)
    rows = []
    for key, found in cut.collect():  # two for each range at most
        n = before = 0
        for block, count, tokens, _ in found:
            rows.append((key, block, n, before, found[0]["lead"]))
            n, before = n + count, before + tokens
    return F.broadcast(turns.sparkSession.createDataFrame(rows, "key string, block int, more long, ahead long, whole long"))


def chat_windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512) -> DataFrame:
    r"""Format conversations as windows of at most ``budget`` tokens, cut between turns only: written.

    Needs conv_id, turn, role, text; returns conv_id, window, first_turn,
    n_retained, n_repeated, n_new, tokens, text and loss, an array of the start
    and length (code points) of the spans to be learnt.

    Prefix sums of the turns' tokens lay a grid of what is left of the budget
    after the system turn and ``history`` (a quarter of the budget at least).
    Turns that end in the cell where they begin make a window; one that crosses
    the cell's end makes its own. So each turn is new in one window, windows
    are in the order of turns, and the rule needs no scan of a conversation. A
    window starts with the system turn (the first turn, if its role is system)
    and the last whole turns before it, of ``history`` tokens and of what the
    budget leaves at most. The mask has the texts of new assistant turns: what
    is repeated is never learnt twice. A single turn over the budget is a window
    over the budget: texts are never cut.

    A turn is ``<turn role>``, line end, text, ``</turn>``, line end. Texts that hold
    such marks or backslashes are escaped reversibly, roles too.

    Nulls in role and text are ''; a null turn stands first; turns of the same
    number are in the order of role and MD5 of the text, and each repeated row
    is a turn; rows of null conv_id are one conversation. Empty texts are turns.
    An empty table gives an empty result. Other columns are not read.

    Sorting cuts conversations that are most of the table, joins and groups go
    by conversation and cell, which hold a budget of tokens, and the system
    turn of a conversation with many windows is repeated for several tasks.
    """
    turns = numbered_turns(conversations, tokenizer)
    rest = turns.join(_cut_conversations(turns), ["key", "block"], "left")
    n, lead = F.col("n") + F.coalesce("more", F.lit(0)), F.coalesce("whole", "lead")
    leads = (n == 0) & (F.col("role") == SYSTEM)
    whole = rest.select(
        "key", "conv_id", "role", "text", n.alias("n"), lead.alias("lead"), leads.alias("leads"), F.when(leads, 0).otherwise(F.col("tokens")).alias("cost"),
        F.when(n == 0, 0).otherwise(F.col("before") + F.coalesce("ahead", F.lit(0)) - lead).alias("before"),
    )
    whole = whole.withColumn("room", F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(max(1, budget // 4))).cast("long"))
    whole = whole.withColumn("cell", F.expr("before div room")).withColumn("part", (F.col("before") + F.col("cost") > (F.col("cell") + 1) * F.col("room")).cast("int"))
    where = ["key", "cell", "part"]
    windows = staged(whole.groupBy(*where).agg(F.min("before").alias("at"), F.sum("cost").alias("fresh"), F.min("n").alias("first_turn"), F.max("lead").alias("lead")), "windows")

    piece = ["role", "text", "n"]
    new = whole.select(*where, F.lit(NEW).alias("kind"), *piece)
    later = F.explode(F.sequence("cell", F.expr(f"(before + {history}) div room")))
    limit = F.least(F.lit(history), budget - F.col("lead") - F.col("fresh"))
    near = whole.where(~F.col("leads")).select("key", later.alias("cell"), "before", *piece)
    repeated = near.join(windows.select(*where, "at", limit.alias("limit")), ["key", "cell"]).where("before < at and before >= at - limit").select(*where, F.lit(REPEATED).alias("kind"), *piece)
    leading = whole.where("leads").select("key", *piece)
    retained = salted_join(windows.where("lead > 0 and first_turn > 0").select(*where), leading, ["key"], "cell").select(*where, F.lit(RETAINED).alias("kind"), *piece)

    head, body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n")), escape(F.col("text"))
    pieces = new.unionByName(repeated).unionByName(retained).select(*where, "kind", "n", "role", head.alias("head"), body.alias("body"))
    long = F.length("head") + F.length("body") + len(SHUT)
    start = F.coalesce(F.sum(long).over(Window.partitionBy(*where).orderBy("kind", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    learnt = (F.col("kind") == NEW) & (F.col("role") == TARGET)
    held = pieces.withColumn("start", start).groupBy(*where).agg(
        F.min(F.when(F.col("kind") == NEW, F.col("n"))).alias("first_turn"),
        *[F.count(F.when(F.col("kind") == k, True)).alias(c) for k, c in ((RETAINED, "n_retained"), (REPEATED, "n_repeated"), (NEW, "n_new"))],
        F.sort_array(F.collect_list(F.struct("kind", "n", "head", "body"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(learnt, F.struct("start", F.length("body").cast("long").alias("chars"))))).alias("loss"),
    )
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(SHUT))), "")
    # conv_id as it was: the key names it
    kind = turns.schema["conv_id"].dataType
    conv = F.when(F.col("key") != "", F.expr("substr(key, 2)").cast(kind))
    out = held.select(conv.alias("conv_id"), (F.col("cell") * 2 + F.col("part")).alias("window"), "first_turn", "n_retained", "n_repeated", "n_new", text.alias("text"), "loss")
    written = staged(out, "chat", compression="zstd")
    unstage(turns)
    unstage(windows)
    return written


def window_turns(windows: DataFrame) -> DataFrame:
    """Read windows back: adds ``turns``, an array of role, text and whether the turn is repeated, and ``learnt``, the texts under the mask."""
    shown = F.split("text", SHUT)
    shown = F.slice(shown, 1, F.size(shown) - 1)  # nothing is behind the last mark

    def parsed(x: Column, i: Column) -> Column:
        halves = F.split(x, ">\n", 2)
        role = unescape_role(F.substring(halves[0], len(OPEN) + 1, 1 << 30))
        return F.struct(role.alias("role"), unescape(halves[1]).alias("text"), (i < F.col("n_retained") + F.col("n_repeated")).alias("repeated"))

    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return windows.withColumn("turns", F.transform(shown, parsed)).withColumn("learnt", learnt)


def chat_digests(windows: DataFrame) -> DataFrame:
    """For each conversation, what its windows hold: turns once, and all text under the mask, as SHA-256.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars and n_windows. Windows without loss add none; an empty table
    gives an empty result. A hash of a whole conversation can only be taken in
    order: its windows are sorted into one task and pass through it, one Arrow
    batch at a time.
    """
    fresh = F.filter("turns", lambda t: ~t["repeated"])
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = window_turns(windows).select("conv_id", "window", F.size(fresh).cast("long").alias("n"), said.alias("said"), F.array_join("learnt", "").alias("learnt"), F.length("text").cast("long").alias("chars"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kind = windows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, n, chars, shown, count = False, None, 0, 0, 0, 0
        said, learnt = hashlib.sha256(), hashlib.sha256()
        ended: list[tuple] = []

        def made(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*ended, strict=True)) or [[]] * len(names)
            kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            ended.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        schema = None
        for batch in batches:
            schema = batch.schema
            for c, m, s, t, k in zip(*[batch[x].to_pylist() for x in ("conv_id", "n", "said", "learnt", "chars")], strict=True):
                if not begun or c != conv:
                    if begun:
                        ended.append((conv, n, said.hexdigest(), chars, learnt.hexdigest(), shown, count))
                    begun, conv, n, chars, shown, count = True, c, 0, 0, 0, 0
                    said, learnt = hashlib.sha256(), hashlib.sha256()
                said.update(s.encode())
                learnt.update(t.encode())
                n, chars, shown, count = n + m, chars + len(t), shown + k, count + 1
            if ended:
                yield made(schema)
        if begun:
            ended.append((conv, n, said.hexdigest(), chars, learnt.hexdigest(), shown, count))
            yield made(schema)

    return small_batches(rows).mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
