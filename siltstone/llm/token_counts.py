"""Token counts by a two-tier lookup of pre-token lengths, map-side.

Byte-level BPE never crosses a pre-token, so a text's count is the sum of its
pre-tokens' lengths. Texts are cut into pre-tokens a megabyte at a time, by
whole arrays:

1. A first pass finds the frequent pre-tokens of all texts: each task keeps a
   summary of ``FREQUENT`` counters (Misra and Gries), and ``treeReduce`` merges
   the summaries, so that every short pre-token with more than 1 / ``FREQUENT``
   of all is among them. The driver looks up their lengths and broadcasts them
   as one hash table of at most 2 MB.
2. The second pass sums the lengths of each text. A pre-token outside the table
   is encoded once for each worker, which caches its length.

No pre-token is shuffled, and the table decides only what is looked up where:
counts never depend on it. A character counts as a letter, number or space by
Unicode 3.2 where today's Unicode agrees; a stretch of text with any other
character goes through the library itself.
"""

from __future__ import annotations

import functools
import json
import math
import os
import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import units
from siltstone.llm.common import Batches, map_arrow
from siltstone.llm.tokens import _byte_letters, raw_text

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Counters of a summary, and the most pre-tokens in the broadcast table.
FREQUENT = 32_768
#: Pre-tokens that a worker caches; beyond that it starts afresh.
KEPT = 1_000_000
#: Summaries that meet in one step of the tree.
FAN_IN = 8

_SPACE, _LETTER, _NUMBER, _OTHER, _END, _UNKNOWN = range(6)
#: Where a long text may be cut: before one white space character between visible ones.
_CUT = re.compile(rb"[!-~](?=[ \n\t][!-~])")
#: What the byte-level pre-tokenizer splits off after an apostrophe (fixed values of its pattern).
_ONE, _TWO = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, _UNKNOWN, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    for c in range(0x110000):
        a, b = old(chr(c)), unicodedata.category(chr(c))
        if a[0] == b[0] and a not in ("Cn", "Cs", "Co"):
            out[c] = kinds.get(a[0], _OTHER)
    out[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    return out


def segments(text: bytes, special: list[bytes], most: int) -> Iterator[bytes]:
    """A text without its special strings, in pieces that no pre-token crosses."""
    parts = re.split(b"|".join(map(re.escape, special)), text) if special and any(s in text for s in special) else [text]
    for part in parts:
        at = 0
        while len(part) - at > most:
            found = _CUT.search(part, at + most)
            if not found:
                break
            yield part[at : found.end()]
            at = found.end()
        yield part[at:]


def pre_tokens(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of all pre-tokens of segments that end at ``ends``, and which segments hold an unknown character.

    ``raw`` has one byte behind each segment, which belongs to none.
    """
    codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    bytes_of = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # where each character starts
    stop = np.searchsorted(bytes_of, ends)
    kind = classes()[codes]
    kind[stop] = _END
    odd = np.zeros(len(ends), bool)
    odd[np.searchsorted(stop, np.flatnonzero(kind == _UNKNOWN))] = True
    before = np.concatenate([[_END], kind[:-1]]).astype(np.uint8)
    flag = (kind != before) | (kind == _END)
    blank = codes == 32
    # The last white space before something visible is alone, or joins it if it is a blank.
    visible = (kind != _SPACE) & (kind != _END)
    first = np.flatnonzero(visible & (before == _SPACE))
    flag[first - 1] = True
    flag[first[blank[first - 1]]] = False
    apart = np.flatnonzero((codes == 39) & flag)
    if len(apart):
        c = np.concatenate([codes, [0, 0]])
        said = lambda w, k: (c[apart + 1] == w[0]) & ((c[apart + 2] == w[1]) if k == 2 else True)
        one = np.logical_or.reduce([said(w, 1) for w in _ONE])
        two = np.logical_or.reduce([said(w, 2) for w in _TWO])
        flag[apart[one | two] + 1] = False
        flag[apart[one] + 2] = True
        flag[apart[two] + 3] = True
    at = np.flatnonzero(flag)
    size = np.diff(np.append(bytes_of[at], len(raw)))
    real = kind[at] != _END
    return bytes_of[at[real]], size[real], odd


@dataclass
class Summary:
    """Counters of short pre-tokens; counts are low by at most 1 / ``FREQUENT`` of all."""

    first: np.ndarray
    second: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Summary:
        return cls(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))

    def merged(self, *others: Summary, most: int = FREQUENT) -> Summary:
        first, second, n = (np.concatenate([getattr(x, c) for x in (self, *others)]) for c in ("first", "second", "n"))
        at, same = units.distinct(first, second)
        n = np.bincount(same, n, len(at)).astype(np.int64)
        first, second = first[at], second[at]
        if len(n) > most:
            less = np.partition(n, len(n) - most - 1)[len(n) - most - 1]
            keep = n > less
            first, second, n = first[keep], second[keep], n[keep] - less
        return Summary(first, second, n)


class Counter:
    """Token counts of texts by one tokenizer; one instance for each worker and file."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        self.pieces = self.tokenizer = None
        self.cut = False
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            made = json.loads(self.tokenizer.to_str())
            step = made["pre_tokenizer"] or {}
            #: Other tokenizers than plain byte-level BPE go through the library alone.
            self.cut = made["model"]["type"] == "BPE" and made["normalizer"] is None and step.get("type") == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
            added = made["added_tokens"]
            self.cut = self.cut and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
            self.special = sorted((x["content"].encode() for x in added), key=len, reverse=True)
        letters = _byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.common: units.KeyTable | None = None
        self.lengths = np.empty(0, np.int64)
        self.own = units.KeyTable(21)
        self._clear()

    def _clear(self) -> None:
        self.own.clear()
        self.own_lengths = np.zeros(1 << 16, np.int64)
        self.n_own, self.long = 0, {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> int:
        """By the library alone."""
        if self.pieces is not None:
            return len(self.pieces.encode(text))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def length(self, unit: bytes) -> int:
        """Tokens of one pre-token."""
        letters = self.letters
        return len(self.tokenizer.model.tokenize("".join([letters[b] for b in unit])))

    def chunks(self, texts: Iterable[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Segments joined to about a megabyte: the bytes, where each segment ends, and which text it is of."""
        have, owner, size = [], [], 0

        def joined():
            sizes = np.array([len(x) for x in have])
            return b"\n".join(have) + b"\n", np.cumsum(sizes + 1) - 1, np.array(owner)

        for i, text in enumerate(texts):
            for part in segments(text, self.special, units.CHUNK):
                if part:
                    have.append(part)
                    owner.append(i)
                    size += len(part) + 1
                if size >= units.CHUNK:
                    yield joined()
                    have, owner, size = [], [], 0
        if have:
            yield joined()

    def _keys(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The short pre-tokens, and both halves of their keys."""
        padded = np.frombuffer(raw + bytes(units.KEY_BYTES), np.uint8)
        short = size <= units.KEY_BYTES
        if b"\0" in raw:
            zeros = np.concatenate([[0], np.cumsum(padded == 0)])
            short &= zeros[start + size] == zeros[start]
        short = np.flatnonzero(short)
        return short, *units.keys_of(padded, start[short], size[short])

    def summary(self, texts: Iterable[bytes]) -> Summary:
        """The frequent short pre-tokens of texts."""
        held, wait, n = Summary.empty(), [], 0
        for raw, ends, _ in self.chunks(texts):
            start, size, _ = pre_tokens(raw, ends)
            _, first, second = self._keys(raw, start, size)
            wait.append(Summary.empty().merged(Summary(first, second, np.ones(len(first), np.int64)), most=len(first)))
            n += len(wait[-1].n)
            if n > 8 * FREQUENT:
                held, wait, n = held.merged(*wait), [], 0
        return held.merged(*wait)

    def take(self, common: tuple[units.KeyTable, np.ndarray]) -> None:
        """Use a table of frequent pre-tokens."""
        self.common, self.lengths = common

    def table(self, found: Summary) -> tuple[units.KeyTable, np.ndarray]:
        """The lengths of frequent pre-tokens, as one hash table at most two thirds full."""
        out = units.KeyTable(max(4, math.ceil(math.log2(1.5 * len(found.n) + 1))))
        raw = np.stack([found.first, found.second], axis=1).astype("<u8").tobytes()
        keys = [raw[i : i + 16].rstrip(b"\0") for i in range(0, len(raw), 16)]
        out.add(found.first, found.second, np.arange(len(keys)))
        return out, np.array([self.length(k) for k in keys], np.int64)

    def _lengths(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.n_own > KEPT or len(self.long) > KEPT:
            self._clear()
        out = np.zeros(len(start), np.int64)
        short, first, second = self._keys(raw, start, size)
        got = np.full(len(short), -1, np.int64)
        if self.common is not None:
            at = self.common.find(first, second)
            got[at >= 0] = self.lengths[at[at >= 0]]
        left = np.flatnonzero(got < 0)
        at = self.own.find(first[left], second[left])
        got[left[at >= 0]] = self.own_lengths[at[at >= 0]]
        left = left[at < 0]
        if len(left):
            one, same = units.distinct(first[left], second[left])
            pick = short[left[one]]
            fresh = np.array([self.length(raw[a : a + n]) for a, n in zip(start[pick].tolist(), size[pick].tolist(), strict=True)], np.int64)
            numbers = np.arange(self.n_own, self.n_own + len(fresh))
            while numbers[-1] >= len(self.own_lengths):
                self.own_lengths = np.append(self.own_lengths, np.zeros_like(self.own_lengths))
            self.own_lengths[numbers] = fresh
            if len(fresh) + self.n_own < 4 * KEPT // 3:
                self.own.add(first[left[one]], second[left[one]], numbers)
                self.n_own += len(fresh)
            got[left] = fresh[same]
        out[short] = got
        rest = np.ones(len(start), bool)
        rest[short] = False
        for i in np.flatnonzero(rest).tolist():
            unit = raw[start[i] : start[i] + size[i]]
            if (n := self.long.get(unit)) is None:
                n = self.length(unit)
                if len(unit) <= 4096:
                    self.long[unit] = n
            out[i] = n
        return out

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if not self.cut:
            return np.array([self.whole(t.decode()) for t in texts], np.int64)
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = len(re.findall(b"|".join(map(re.escape, self.special)), t))
        for raw, ends, owner in self.chunks(texts):
            start, size, odd = pre_tokens(raw, ends)
            n = np.concatenate([[0], np.cumsum(self._lengths(raw, start, size))])
            upto = n[np.searchsorted(start, ends)]
            each = np.diff(upto, prepend=0)
            for i in np.flatnonzero(odd).tolist():
                each[i] = self.whole(raw[ends[i - 1] + 1 if i else 0 : ends[i]].decode())
            np.add.at(out, owner, each)
        return out


def _summaries(tokenizer: str):
    def run(batches: Batches) -> Batches:
        counter = Counter.of(tokenizer)
        held = counter.summary(raw_text(x) for batch in batches for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["summary"])

    return run


def frequent(docs: DataFrame, tokenizer: str) -> Summary:
    """The frequent short pre-tokens of all texts."""
    parts = map_arrow(docs.select("text").where("text <> ''"), _summaries(tokenizer), "summary binary").rdd.map(lambda r: pickle.loads(r[0]))
    n = parts.getNumPartitions()
    return parts.treeReduce(Summary.merged, max(2, math.ceil(math.log(n, FAN_IN)))) if n else Summary.empty()


def _counts(tokenizer: str, common, limit: int):
    def run(batches: Batches) -> Batches:
        counter = Counter.of(tokenizer)
        if common is not None:
            counter.take(common.value)
        for batch in batches:
            n = counter.counts([raw_text(x) for x in batch.column(1)])
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The tokens of every whole text, as the tokenizer's library counts them.

    Input: ``doc_id`` and ``text``; other columns are ignored. Output, a row for
    each input row: ``doc_id, n_bytes, n_tokens, over_limit``. Null and empty
    texts have no bytes and no tokens. Null ids stay; rows that repeat are
    counted each. Special strings inside a text count as the library counts
    them by default. Long texts count whole; a single pre-token must fit a
    worker's memory. A count of exactly ``limit`` isn't over it. An empty table
    gives no rows.

    ``tokenizer`` is a path that every executor can read: ``.json`` of
    ``tokenizers`` or ``.model`` of ``sentencepiece``. Others than plain
    byte-level BPE are counted by the library alone.
    """
    path = tokenizer or default_tokenizer()
    counter = Counter.of(path)
    common = None
    if counter.cut:
        common = docs.sparkSession.sparkContext.broadcast(counter.table(frequent(docs, path)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _counts(path, common, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
