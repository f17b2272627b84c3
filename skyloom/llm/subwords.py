"""Subword ids of whole texts from the tokenizers library, with a cache of words."""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the cache keeps at most, and the longest that it keeps.
CACHE_WORDS = 500_000
CACHE_BYTES = 48
#: Words of one string that the library encodes at a time.
JOINED = 1000
#: Letters, then signs: both kinds of files split such a word between the two and nowhere else.
PARTS = re.compile(r"([^\W\d_]+)([^\w\s']*)")
# fixed value: the split of files that lower case and drop white space
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordCachedTokenizer:
    """Encodes word by word, and each distinct word once.

    For files that drop white space this gives what the library gives for the
    whole text: such a tokenizer never joins what white space parts. Words go
    to the library with A-Z in lower case, unless the text has what might be a
    special token and ``prefix`` is empty. With a ``prefix``, each word is
    encoded behind it, and the strings of special tokens are ordinary text.
    """

    _held: dict[tuple[str, str], WordCachedTokenizer] = {}

    def __init__(self, path: str, prefix: str = ""):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = bool(prefix)
        self.prefix, self.limit = prefix, CACHE_WORDS
        self.cache: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.bare, self.lowers = self._bare(Tokenizer.from_file(path))

    def _bare(self, copy):
        """A copy without normaliser and split, for words that need neither; None for files of another make."""
        import json

        from tokenizers import Regex, normalizers, pre_tokenizers

        made = json.loads(copy.to_str())
        split, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        first = (split.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        lowers = steps == ["NFC", "Replace", "Lowercase"] and first == WORD_SPLIT and not self.prefix
        plain = norm is None and split.get("type") == "ByteLevel" and split.get("use_regex") and self.prefix == " "
        if not (lowers or plain):
            return None, False
        copy.normalizer = normalizers.Sequence([])
        blank = pre_tokenizers.Split(Regex(" [^ ]+"), "isolated") if self.prefix else pre_tokenizers.Split(" ", "removed")
        copy.pre_tokenizer = pre_tokenizers.Sequence([blank, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        copy.encode_special_tokens = True
        suffix = made["model"].get("end_of_word_suffix") or ""
        if lowers and not suffix:
            return None, False
        pieces = made["model"]["vocab"]
        self.marked = np.zeros(copy.get_vocab_size(), bool)
        self.marked[[i for t, i in pieces.items() if (t.startswith("Ġ") if self.prefix else t.endswith(suffix))]] = True
        return copy, lowers

    def _parts(self, word: str, checked: bool) -> tuple[str, str] | None:
        """Letters and signs of a word that is already as the normaliser would leave it; ``checked`` says that it is."""
        found = (word, word, "") if word.isalpha() else PARTS.fullmatch(word)
        if not found or not found[1].isalpha() or "<|" in word:
            return None
        if not checked and self.lowers and not word.isascii() and (word != word.lower() or not is_normalized("NFC", word)):
            return None
        return found[1], found[2]

    def _tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            self.tails[signs] = array("I", self.bare.encode(signs, add_special_tokens=False).ids).tobytes()
        return self.tails[signs]

    def _spell(self, heads: list[bytes]) -> None:
        """Put the ids of words of letters into the cache, many by one call; a mark in the ids shows where each word ends or begins."""
        known, joint = self.cache, [heads[i : i + JOINED] for i in range(0, len(heads), JOINED)]
        texts = [(b" " * bool(self.prefix) + b" ".join(part)).decode() for part in joint]
        for part, e in zip(joint, self.bare.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(self.marked[ids])
            ends = np.append(marks[1:], len(ids)) if self.prefix else marks + 1
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                known[w] = raw[at:end]
                at = end

    def _learn(self, fresh: list[bytes]) -> None:
        """Put the ids of words into the cache: letters and signs apart where that is the same."""
        known, whole, split, wide, others = self.cache, [], [], set(), []
        for w in fresh:
            if self.bare is None or (self.lowers and w != w.lower()):  # capitals beside what may be a special token
                whole.append(w)
            elif w.isalpha():  # letters of one byte
                wide.add(w)
            elif w[:-1].isalpha() and w[-1:] in b".,!?;:":
                wide.add(w[:-1])
                split.append((w, w[:-1], w[-1:].decode()))
            else:
                others.append(w)
        joint = b"\n".join(others).decode()  # no word has a line end, so all are decoded and checked together
        checked = joint == joint.lower() and is_normalized("NFC", joint)
        for w, text in zip(others, joint.split("\n"), strict=bool(others)):
            parts = self._parts(text, checked)
            if parts is None:
                whole.append(w)
            elif parts[1]:
                head = parts[0].encode()
                wide.add(head)
                split.append((w, head, parts[1]))
            else:
                wide.add(w)
        self._spell([h for h in wide if h not in known])
        for w, head, tail in split:
            known[w] = known[head] + self._tail(tail)
        if len(self.tails) > self.limit:
            self.tails = {}
        if whole:
            for w, e in zip(whole, self.tokenizer.encode_batch_fast([self.prefix + w.decode() for w in whole], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    @classmethod
    def at(cls, path: str, prefix: str = "", limit: int = CACHE_WORDS) -> WordCachedTokenizer:
        """One for each file and worker process, that keeps ``limit`` words at most."""
        if (path, prefix) not in cls._held:
            cls._held[path, prefix] = cls(path, prefix)
        cls._held[path, prefix].limit = limit
        return cls._held[path, prefix]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Words are numbered, so that the cache is asked once for each distinct one of the run."""
        data = [t if b"<|" in t and not self.prefix else t.lower() for t in texts]
        ends = np.cumsum([0, *map(len, data)])
        strings = pa.Array.from_buffers(pa.large_string(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])
        split = pc.ascii_split_whitespace(strings)  # may give empty words at the ends
        coded = split.values.dictionary_encode()
        words, codes = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.cache) > self.limit:  # what is frequent is in this run as well
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        self.cache[b""] = b""
        spelled = list(map(self.cache.get, words))
        order = [w for w, x in zip(words, spelled, strict=True) if x is None]
        if order:
            self._learn(order)
            spelled = [self.cache[w] if x is None else x for w, x in zip(words, spelled, strict=True)]
        for w in order:
            if len(w) > CACHE_BYTES:
                self.cache.pop(w, None)
        flat = np.frombuffer(b"".join(spelled), np.uint32)
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        size = sizes[codes]
        stop = np.cumsum(np.append(0, size))
        kind = np.int32 if max(stop[-1], len(flat)) < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(sizes) - sizes)[codes] - stop[:-1]).astype(kind), size)
        place += np.arange(len(place), dtype=kind)
        return np.split(flat[place], stop[split.offsets.to_numpy()[1:-1]]) if texts else []
