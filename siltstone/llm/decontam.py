"""Benchmark decontamination: BM25 over test items with block-max pruning.

The test items are the indexed side; each passage of a training document is a
query. Impacts are scaled so that a passage with all of an item's words scores
1 for it, and all items at or over a threshold are retrieved. Items lie in
blocks; for each block the index keeps the largest impact of the terms that it
has, in sparse form. A passage's bound for a block is the sum of its terms'
largest impacts there, and blocks whose bound is under the threshold are
skipped. In the others WAND pivots on the sorted postings, so only items that
can reach the threshold are scored. Retrieved items are then verified on word
trigrams of their question and of their answer.

Texts are cut into words and bounded a chunk at a time. A test item of over
``LONG_ITEM`` words is indexed as several sections, so it doesn't widen the
passages; it is verified on all passages that its sections retrieved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import units
from siltstone.llm.common import Batches, Scratch, map_arrow, plus
from siltstone.llm.tokens import raw_text

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
SHORT_PART = 5
ITEMS_IN_BLOCK = 8
STRIDE = 32
#: Words of an item over which it is indexed as sections.
LONG_ITEM = 256
#: Cells of (passage, block) that are bounded together.
CELLS = 1 << 21
#: Items of one index part; what is shipped to the executors is bounded by it. More items are searched part by part.
MAX_PART = 20_000
_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[95, *range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Second bytes of two-byte Latin letters (first byte 0xC3), and those of upper case.
_SECOND, _UPPER_SECOND = np.zeros(256, bool), np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_UPPER_SECOND[0x80:0x9F] = _SECOND[0x80:0x9F]


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: cut after the last question mark that something follows, else before the last sentence. Where either would have under five words, the answer is the last third."""
    t = text.strip()
    cut = t[:-1].rfind("?") + 1
    if cut:
        q, a = t[:cut], t[cut:]
    else:
        parts = _SENTENCE.split(t)
        q, a = " ".join(parts[:-1]), parts[-1]
    q, a = words_of(q), words_of(a)
    if min(len(q), len(a)) < SHORT_PART:
        w = q + a
        k = len(w) - len(w) // 3
        q, a = w[:k], w[k:]
    return q, a


def trigrams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """Word trigrams; fewer words are one shorter n-gram."""
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share_of(part: set[tuple[str, ...]], passage: list[str], have: set[tuple[str, ...]]) -> float:
    """How much of a part's n-grams a passage has; 1 for an empty part."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    return len(part & (have if n == 3 else trigrams(passage, n))) / len(part)


def sections(words: list[str]) -> list[list[str]]:
    """An item's words in equal runs of at most ``LONG_ITEM``."""
    k = max(1, -(-len(words) // LONG_ITEM))
    return [words[len(words) * i // k : len(words) * (i + 1) // k] for i in range(k)]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for every i."""
    upto = np.cumsum(count)
    return np.repeat(start - upto + count, count) + np.arange(int(upto[-1]) if len(upto) else 0)


@dataclass
class Index:
    """Postings of sections in order, sparse block maxima, and what verification needs."""

    items: list[int]
    parts: list[tuple[set, set]]
    owner: list[int]
    """The item of each section."""
    terms: dict[str, int]
    ptr: np.ndarray
    """Postings of term t are those from ptr[t] to ptr[t + 1]: ``section`` and ``impact``."""
    section: np.ndarray
    impact: np.ndarray
    block_ptr: np.ndarray
    """Blocks with term t and its largest impacts there, likewise."""
    block: np.ndarray
    block_max: np.ndarray
    n_blocks: int
    window: int
    table: units.KeyTable = field(repr=False)
    long_terms: dict[bytes, int] = field(repr=False)

    @staticmethod
    def build(rows: list[tuple[int, str]], df: dict[str, int] | None = None, n_all: int | None = None, mean: float | None = None) -> Index:
        """``df``, ``n_all``, ``mean``: statistics over the sections of all items if these are only a part of them."""
        rows = sorted((i, t) for i, t in rows if i is not None and words_of(t))
        bags, owner = [], []
        for k, (_, t) in enumerate(rows):
            for bag in sections(words_of(t)):
                bags.append(bag)
                owner.append(k)
        n = n_all or len(bags)
        if df is None:
            df = {}
            for bag in bags:
                for w in set(bag):
                    df[w] = df.get(w, 0) + 1
        mean = mean or sum(map(len, bags)) / max(1, len(bags))
        terms = {w: k for k, w in enumerate(sorted({w for bag in bags for w in bag}))}
        found: list[tuple[int, int, float]] = []
        for j, bag in enumerate(bags):
            tf: dict[str, int] = {}
            for w in bag:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(bag) / mean)
            impact = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            whole = sum(impact.values())
            found += [(terms[w], j, float(x / whole)) for w, x in impact.items()]
        found.sort()
        term = np.array([f[0] for f in found], np.int64)
        section, value = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found])
        ptr = np.searchsorted(term, np.arange(len(terms) + 1))
        n_blocks = -(-len(bags) // ITEMS_IN_BLOCK)
        cell = term * max(1, n_blocks) + section // ITEMS_IN_BLOCK
        cells, first = np.unique(cell, return_index=True)
        block_max = np.maximum.reduceat(value, first) if len(first) else np.empty(0)
        block_ptr = np.searchsorted(cells // max(1, n_blocks), np.arange(len(terms) + 1))
        table = units.KeyTable(max(8, (2 * len(terms)).bit_length()))
        raw = {w.encode(): k for w, k in terms.items()}
        short = [w for w in raw if len(w) <= units.KEY_BYTES]
        if short:
            size = np.array([len(w) for w in short])
            padded = np.frombuffer(b"".join(short) + bytes(units.KEY_BYTES), np.uint8)
            table.add(*units.keys_of(padded, np.cumsum(size) - size, size), np.array([raw[w] for w in short]))
        qa = [question_and_answer(t) for _, t in rows]
        return Index(
            [i for i, _ in rows], [(trigrams(q), trigrams(a)) for q, a in qa], owner, terms, ptr, section, value, block_ptr,
            cells % max(1, n_blocks), block_max, n_blocks, max(map(len, bags), default=0) + STRIDE, table,
            {w: k for w, k in raw.items() if len(w) > units.KEY_BYTES},
        )

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Sections of one block that score at least the threshold for these distinct terms."""
        low, high = block * ITEMS_IN_BLOCK, (block + 1) * ITEMS_IN_BLOCK
        lists = []
        for t in terms:
            a, b = self.ptr[t], self.ptr[t + 1]
            some = self.section[a:b]
            x, y = np.searchsorted(some, (low, high))
            if x < y:
                impact = self.impact[a + x : a + y].tolist()
                lists.append([some[x:y].tolist(), impact, 0, max(impact)])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= threshold - 1e-6:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                break
            score, keep = 0.0, []
            full = lists[0][0][lists[0][2]] == pivot
            for x in lists:
                at, impact, k, _ = x
                while k < len(at) and at[k] < pivot:
                    k += 1
                if full and k < len(at) and at[k] == pivot:
                    score += impact[k]
                    k += 1
                x[2] = k
                if k < len(at):
                    keep.append(x)
            lists = keep
            if full and score >= threshold - 1e-6:
                found.append((pivot, round(score, 12)))  # the order of summands is not fixed
        return found

    def _codes(self, raw: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The term of each word of a chunk, -1 for other words, and how many words end before each text's end."""
        padded = np.frombuffer(raw, np.uint8)
        codes = padded[: -units.KEY_BYTES]
        inside, low = _IN_WORD[codes], _LOWER[padded]
        odd = codes >= 0x80
        two = np.flatnonzero(codes[:-1] == 0xC3)
        if len(two):
            two = two[_SECOND[codes[two + 1]]]
            inside[two] = inside[two + 1] = True
            odd[two] = odd[two + 1] = False
            low[two + 1] += np.where(_UPPER_SECOND[codes[two + 1]], 32, 0).astype(np.uint8)
        dash = np.flatnonzero((codes[:-1] == 0xE2) & (codes[1:] == 0x80))  # general punctuation
        odd[dash] = odd[dash + 1] = odd[dash + 2] = False
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        size = end - start
        easy = np.flatnonzero(size <= units.KEY_BYTES)
        out = np.full(len(start), -1, np.int64)
        out[easy] = self.table.find(*units.keys_of(low, start[easy], size[easy]))
        if self.long_terms:
            for i in np.flatnonzero(size > units.KEY_BYTES).tolist():
                out[i] = self.long_terms.get(low[start[i] : end[i]].tobytes(), -1)
        upto = np.searchsorted(start, ends)
        if odd.any():  # texts with other letters are cut by the pattern itself
            so_far = np.concatenate([[0], np.cumsum(odd)])
            parts, a, first = [], 0, 0
            for k, b in enumerate(ends):
                if so_far[b] > so_far[a]:
                    parts.append(np.array([self.terms.get(w, -1) for w in words_of(raw[a:b].decode())], np.int64))
                else:
                    parts.append(out[first : upto[k]])
                a, first = b, upto[k]
            out, upto = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return out, upto

    def _candidates(self, codes: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, first word, word behind, block) of passages whose bound reaches the threshold. ``ends``: where texts end in ``codes``."""
        begin = np.concatenate([[0], ends[:-1]])
        n = ends - begin
        count = np.where(n > 0, np.maximum(1, -(-(n - self.window + STRIDE) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        starts = begin[text] + STRIDE * _spread(np.zeros(len(n), np.int64), count)
        stops = np.minimum(starts + self.window, ends[text])
        place = np.flatnonzero(codes >= 0)
        term = codes[place]
        order = np.argsort(term, kind="stable")
        before = np.full(len(place), -1, np.int64)  # where the term was last seen
        again = term[order][1:] == term[order][:-1]
        before[order[1:][again]] = place[order[:-1][again]]
        # A term counts once: from the first passage after its last occurrence to the last passage that holds it.
        enter = np.maximum(np.searchsorted(stops, place, "right"), np.searchsorted(starts, before, "right"))
        leave = np.searchsorted(starts, place, "right")
        live = enter < leave
        enter, leave, term = enter[live], leave[live], term[live]
        order = np.argsort(enter, kind="stable")
        enter, leave, term = enter[order], leave[order], term[order]
        longest = int((leave - enter).max(initial=0))
        step = max(64, CELLS // max(1, self.n_blocks))
        for w in range(0, len(starts), step):
            top = min(w + step, len(starts))
            a, b = np.searchsorted(enter, (w - longest, top))
            t = term[a:b]
            size = self.block_ptr[t + 1] - self.block_ptr[t]
            cell = _spread(self.block_ptr[t], size)
            block, most = self.block[cell], self.block_max[cell]
            into = np.repeat(np.maximum(enter[a:b] - w, 0), size) * self.n_blocks + block
            out = np.repeat(np.clip(leave[a:b] - w, 0, top - w), size) * self.n_blocks + block
            cells = (top - w + 1) * self.n_blocks
            change = np.bincount(into, most, cells) - np.bincount(out, most, cells)
            bound = np.cumsum(change.reshape(top - w + 1, self.n_blocks), axis=0)[:-1]
            for i, k in zip(*np.nonzero(bound >= threshold - 1e-6), strict=True):
                yield int(text[w + i]), int(starts[w + i]), int(stops[w + i]), int(k)

    def _coded(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The terms of texts and where each ends: of several short ones, or of a long one."""
        wait: list[np.ndarray] = []
        for raw, ends, goes_on in units.chunks(texts):
            codes, upto = self._codes(raw, ends)
            if goes_on or wait:
                wait.append(codes.astype(np.int32))
                if not goes_on:
                    x = np.concatenate(wait)
                    wait = []
                    yield x, np.array([len(x)])
            else:
                yield codes, upto

    def search_many(self, texts: list[bytes], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple[int, float, float, float]]]:
        """For each text its verified matches: (item, best score, question overlap, answer overlap)."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        first = 0
        several = np.bincount(self.owner) > 1
        for codes, ends in self._coded(texts):
            best: dict[tuple[int, int], tuple] = {}
            seen: dict[tuple[int, int], list] = {}  # of items in sections: best score, trigrams, shares
            words: tuple[int, list[str]] = (-1, [])
            for k, a, b, block in self._candidates(codes, ends, threshold):
                inside = codes[a:b]
                hits = self.wand(np.unique(inside[inside >= 0]).tolist(), block, threshold)
                if not hits:
                    continue
                if words[0] != k:
                    words = (k, words_of(texts[first + k].decode()))
                base = int(ends[k - 1]) if k else 0
                passage = words[1][a - base : b - base]
                have = trigrams(passage)
                for j, score in hits:
                    i = self.owner[j]
                    if several[i]:
                        x = seen.setdefault((k, i), [0.0, set()])
                        x[0] = max(x[0], score)
                        x[1] |= have
                        continue
                    q, ans = (share_of(p, passage, have) for p in self.parts[i])
                    if q >= overlap and ans >= overlap and score > best.get((k, i), (0,))[0]:
                        best[k, i] = (score, q, ans)
            for (k, i), (score, have) in seen.items():
                q, ans = (share_of(p, [], have) for p in self.parts[i])
                if q >= overlap and ans >= overlap:
                    best[k, i] = (score, q, ans)
            for (k, i), x in sorted(best.items()):
                out[first + k].append((self.items[i], *x))
            first += len(ends)
        return out

    def search(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        return self.search_many([(text or "").encode()], threshold, overlap)[0]


def _search(index: Index, at: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            leaked, item, count, score, q, a = [], [], [], [], [], []
            for got in index.search_many([raw_text(t) for t in batch.column(at)]):
                top = max(got, key=lambda x: (x[1], -x[0]), default=(None, 0.0, 0.0, 0.0))
                leaked.append(bool(got))
                item.append(top[0])
                count.append(len(got))
                score.append(float(top[1]))
                q.append(top[2])
                a.append(top[3])
            new = [pa.array(leaked, pa.bool_()), pa.array(item, pa.int64()), pa.array(count, pa.int64()), *(pa.array(x, pa.float64()) for x in (score, q, a))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *NEW])

    return run


NEW = ["leaked", "item_id", "n_items", "bm25", "question_overlap", "answer_overlap"]
_KINDS = ["boolean", "long", "long", "double", "double", "double"]


def _indexes(items: DataFrame, max_part: int) -> Iterator[Index]:
    """One index, or one for each part of many items, made when it is asked for."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    parts = max(1, -(-items.count() // max_part))
    if parts == 1:
        yield Index.build([tuple(r) for r in items.collect()])
        return

    def bags(batches: Batches) -> Batches:
        for batch in batches:
            rows = [(w, int(k == 0), len(b)) for t in batch.column(1) for b in sections(words_of(t.as_py())) for k, w in enumerate(sorted(set(b)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["word", "one", "n"])

    words = map_arrow(items, bags, "word string, one long, n long")
    df = words.groupBy("word").count()
    total = words.where("one = 1").agg(F.count("*"), F.avg("n")).first()
    for p in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        own = df.join(map_arrow(mine, bags, "word string, one long, n long").select("word").distinct(), "word")
        yield Index.build([tuple(r) for r in mine.collect()], {r[0]: r[1] for r in own.collect()}, total[0], total[1])


def find_leaks(docs: DataFrame, items: DataFrame, max_part: int = MAX_PART) -> DataFrame:
    """All input columns and ``leaked, item_id, n_items, bm25, question_overlap, answer_overlap`` of every document.

    ``items``: ``item_id, text``; null ids, null texts and texts without words
    index nothing. ``item_id`` is the match with the highest score, the least
    id on ties; ``n_items`` counts all verified matches. Null and empty texts
    match nothing; very long texts are searched whole. Rows that repeat a
    document are searched each; of items that repeat, each counts. Input columns
    with these names are replaced. Over ``max_part`` items are searched part by
    part, the results of each written before the next index is made.
    """
    docs = docs.drop(*NEW)
    new = list(zip(NEW, _KINDS, strict=True))
    at, keep = docs.columns.index("text"), docs.columns
    out, scratch = None, Scratch(docs.sparkSession, "leaks")
    for index in _indexes(items, max_part):
        if out is None:
            out = map_arrow(docs, _search(index, at), plus(docs, *new))
            continue
        out = scratch.save(out, "part")
        renamed = out.select(*keep, *(F.col(c).alias(f"_{c}") for c in NEW))
        both = map_arrow(renamed, _search(index, at), plus(renamed, *new))
        better = (F.col("_bm25") > F.col("bm25")) | ((F.col("_bm25") == F.col("bm25")) & (F.col("_item_id") < F.col("item_id")))
        pick = lambda c: F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        out = both.select(*keep, (F.col("leaked") | F.col("_leaked")).alias("leaked"), pick("item_id"), (F.col("n_items") + F.col("_n_items")).alias("n_items"), pick("bm25"), pick("question_overlap"), pick("answer_overlap"))
    return out
