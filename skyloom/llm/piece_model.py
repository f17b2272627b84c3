"""SentencePiece models on the tokenizers library: parse the protobuf, rebuild, encode, decode, compare."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.arrays import lists, runs, small_batches, utf8

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words of one string that the library encodes at a time.
JOINED = 500
#: Threads of a batch call at least; more where a task has more cores.
THREADS = 2
#: Words that a worker keeps at most, and the longest that it keeps.
CACHE_WORDS = 200_000
CACHE_CHARS = 40


def fields_of(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: integers, raw fixed words or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True
    suffix_mark: bool = False

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in fields_of(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields_of(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields_of(value):
                    if n == 3:
                        model.kind = v
                    elif n == 24:
                        model.suffix_mark = bool(v)
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields_of(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.collapse_spaces = bool(v)
                    elif n == 5:
                        model.escape_spaces = bool(v)
        model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose joining is a piece, the best scored piece first.

        The model joins the best scored pair and, of equal scores, the leftmost;
        the library wants an order of pairs. Pairs of one piece stand next to
        each other, so they have equal rank but for their order among
        themselves, which cannot matter: they join to the same piece.
        """
        usable = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER_DEFINED)}
        order = sorted((i for i, (_, _, k) in enumerate(self.pieces) if k == NORMAL), key=lambda i: (-self.pieces[i][1], i))
        found = []
        for i in order:
            p = self.pieces[i][0]
            own = [(p[:c], p[c:]) for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
            found += sorted(own, key=lambda x: (usable[x[0]], usable[x[1]]))
        return found

    def splits_words(self) -> bool:
        """No piece goes on behind the mark of a next word, so words can be encoded on their own."""
        return all(MARK not in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))

    def unigram(self, decoding: bool) -> list[tuple[str, float]]:
        """Pieces and scores for the library's unigram model.

        Only normal and user-defined pieces may be found in a text. For
        encoding, others get a blank in front, which no text has once blanks
        are marked, and a score that cannot be the lowest, since that sets what
        an unknown character costs. A user-defined piece has the score by which
        the model always prefers it.
        """
        best = max((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
        found = []
        for i, (p, s, k) in enumerate(self.pieces):
            if decoding or k == NORMAL:
                found.append((p, s))
            elif k == USER_DEFINED:
                found.append((p, len(p.encode()) * best - 0.1))
            else:
                found.append((f" {i} {p}", best))
        return found

    def tokenizer(self, decoding: bool = False):
        """The same model on the tokenizers library; for a unigram model, one for encoding and one for decoding.

        Encoding by a unigram model leaves unknown characters as such, and the
        codec spells them in bytes where the model falls back to these.
        """
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unk = self.pieces[self.unk_id][0]
            core = models.BPE(vocab, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            if not self.escape_spaces:
                raise ValueError("only unigram models that mark blanks can be rebuilt")
            core = models.Unigram(self.unigram(decoding), self.unk_id, False)
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.collapse_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.escape_spaces:
            if self.dummy_prefix:
                steps.append(normalizers.Prepend(MARK if not self.suffix_mark else ""))
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.splits_words():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        own = [AddedToken(p, normalized=False) for p, _, k in self.pieces if k == USER_DEFINED]
        if own and (self.kind == BPE or self.charsmap):
            out.add_tokens(own)
        out.encode_special_tokens = True
        tail = [decoders.Strip(content=" ", left=1, right=0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return out


class PieceCodec:
    """A model file on both libraries, one for each worker process."""

    _held: dict[str, PieceCodec] = {}

    def __init__(self, path: str, threads: int):
        from tokenizers import normalizers

        self.threads = threads
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = PieceModel.parse(self.data)
        self.tokenizer, self.decoder = self.model.tokenizer(), self.model.tokenizer(decoding=True)
        #: ids of the bytes that an unknown character of a unigram model is spelled in
        self.bytes = [i for i, (_, _, k) in enumerate(self.model.pieces) if k == BYTE] if self.model.byte_fallback and self.model.kind == UNIGRAM else []
        self.bare = self.model.tokenizer()
        self.bare.normalizer = normalizers.Sequence([])
        #: pieces that begin with the mark
        self.marked = np.array([p.startswith(MARK) and k in (NORMAL, USER_DEFINED) for p, _, k in self.model.pieces])
        self.words: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self._sp = None

    @classmethod
    def at(cls, path: str, threads: int) -> PieceCodec:
        key = f"{path}:{threads}"
        if key not in cls._held:
            cls._held[key] = cls(path, threads)
        return cls._held[key]

    @property
    def sentencepiece(self):
        if self._sp is None:
            import sentencepiece

            self._sp = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._sp

    def _batch(self, tokenizer, texts: list[str]) -> list[list[int]]:
        """Ids of a batch, unknown characters in bytes where the model has them."""
        if len(self.bytes) != 256:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, unk = [], self.model.unk_id
        for e in tokenizer.encode_batch(texts, add_special_tokens=False):  # the fast call has no tokens
            ids = e.ids
            if unk in ids:
                ids = [x for i, token in zip(ids, e.tokens, strict=True) for x in ([self.bytes[b] for b in token.encode()] if i == unk else [i])]
            out.append(ids)
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes, of marked words. Many words go to the library as one string, which it spreads over its threads with others.

        No piece goes on behind a mark, so pieces that begin with one show where
        each word begins; words that are marks only or have more than one go by
        themselves.
        """
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w.rfind(MARK) == 0 and len(w) > 1]
        parts = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for part, ids in zip(parts, self._batch(self.bare, ["".join([words[i] for i in part]) for part in parts]), strict=True):
            ids = np.array(ids, np.uint32)
            heads = np.flatnonzero(self.marked[ids])
            if len(heads) != len(part):
                raise RuntimeError("pieces do not show where words begin")
            raw, ends = ids.tobytes(), (4 * np.append(heads[1:], len(ids))).tolist()
            for i, a, b in zip(part, [0, *ends], ends, strict=False):
                out[i] = raw[a:b]
        rest = [i for i, w in enumerate(words) if not (w.rfind(MARK) == 0 and len(w) > 1)]
        for i, ids in zip(rest, self._batch(self.bare, [words[i] for i in rest]) if rest else [], strict=True):
            out[i] = array("I", ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, by one batch call that the library spreads over its threads."""
        # the library prepends a mark to an empty text, the model gives none; nor to one that is all blanks and loses them
        bare = [not (t.strip(" ") if self.model.collapse_spaces else t) for t in texts]
        return [[] if b else ids for b, ids in zip(bare, self._batch(self.tokenizer, texts), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode_batch(ids, skip_special_tokens=False)

    def _chunks(self, text: str) -> list[str]:
        """The marked words of a text, as the pre-tokenizer splits them; runs of blanks go with the word behind them."""
        marked = MARK + text.replace(" ", MARK)
        if marked.endswith(MARK) or MARK * 2 in marked:
            return CHUNK.findall(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of whole texts, and whether both libraries agree on them.

        A model that only marks blanks and has no piece beyond a word gives a
        text the ids of its marked words in a row, so each distinct word is
        encoded and compared once and kept; other models go text by text.
        """
        m = self.model
        if m.charsmap or m.collapse_spaces or not (m.dummy_prefix and m.escape_spaces) or m.suffix_mark or not m.splits_words() or any(k == USER_DEFINED for _, _, k in m.pieces):
            ids, own = self.encode(texts), self.sentencepiece.encode(texts, num_threads=self.threads)
            return [np.asarray(x, np.uint32) for x in ids], [a == b for a, b in zip(ids, own, strict=True)]
        split = [self._chunks(t) if t else [] for t in texts]
        words = set().union(*split)
        if len(self.words) > CACHE_WORDS:  # what is frequent is in this run as well
            self.words = {w: self.words[w] for w in words.intersection(self.words)}
        fresh = list(words.difference(self.words))
        got = self._word_ids(fresh)
        # the model adds the first mark itself; a mark alone is a piece, since an empty text gets none
        own = self.sentencepiece.encode([w[1:].replace(MARK, " ") for w in fresh], num_threads=self.threads) if fresh else []
        for w, mine, ids in zip(fresh, got, own, strict=True):
            self.words[w] = mine
            if mine != array("I", ids if w != MARK else [self.sentencepiece.piece_to_id(MARK)]).tobytes():
                self.differ.add(w)
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, s)), np.uint32) for s in split]
        agree = [not self.differ or self.differ.isdisjoint(s) for s in split]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del self.words[w]
        return out, agree


def _codec_run(path: str, threads: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.at(path, threads)
        for batch in batches:
            numbers, texts = batch.column(0), utf8(batch.column(1))
            for i, j in runs(texts, 1_000_000):
                plain = [t.decode() for t in texts[i:j]]
                ids, agree = codec.encode_checked(plain)
                back = codec.decode([x.tolist() for x in ids])
                size = np.array([len(x) for x in ids], np.int64)
                columns = [
                    numbers.slice(i, j - i), pa.array(size), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                    pa.array([a == b for a, b in zip(back, plain, strict=True)]), pa.array(agree),
                ]
                if keep_ids:
                    columns.append(lists(np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in ids)]), size, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, PIECE_COLUMNS[: len(columns)])

    return run


PIECE_COLUMNS = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity", "ids"]


def encode_pieces(docs: DataFrame, model: str, threads: int | None = None, keep_ids: bool = True) -> DataFrame:
    """Encode whole texts with a SentencePiece model on the tokenizers library and decode them again.

    Needs doc_id and text; other columns are ignored. Returns doc_id, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    round_trip (the decoded text is the text, which a text with the mark itself
    never is), parity (sentencepiece gives the
    same ids; it is the whole text's, or that of each of its marked words where
    the model has no piece beyond a word) and, if asked, ids. ``threads`` is the
    libraries' number of threads in each worker: the cores of a task, THREADS at
    least, unless it is given. Null text is empty; an empty text has no ids.
    Texts of any length are encoded whole; rows that repeat a doc_id are rows of
    their own. An empty table gives an empty result.
    """
    threads = threads or max(THREADS, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * keep_ids
    return small_batches(docs).select("doc_id", "text").mapInArrow(_codec_run(model, threads, keep_ids), schema)
