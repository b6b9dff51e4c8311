"""Packing documents into training windows by order-preserving dynamic programming.

Documents keep their order. A run of documents is one stream of ids; windows
may be cut at document ends (free), at sentence ends (a truncation penalty) and,
inside sentences too long for that, at words (a larger penalty). The best cuts
minimise padding plus penalties:

    best[j] = min over i of best[i] + padding(at[j] - at[i]) + penalty[j]

with at[j] - at[i] <= window. Padding is window - (at[j] - at[i]), so the least
best[i] + at[i] of a sliding range is wanted: a monotone queue gives it in
constant time for each cut. Windows whose length is a power of two need no
padding and are looked up directly.

Runs end at a document after about two million ids and are packed alone; each
wastes less than one window. So partitions need nothing from each other but
their counts of windows.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, Scratch, map_arrow
from siltstone.llm.tokens import Encoded, Encoder, default_tokenizer, raw_text

WINDOW = 2048
RUN_IDS = 2_000_000
SENTENCE_PENALTY, WORD_PENALTY = 8, 48
#: Stretches without a sentence end over LONG ids get cuts about every STEP ids.
LONG, STEP = 128, 32
#: Shortest window that may stay unpadded as a power of two, and the cost of one more window.
LEAST_POWER, POWER_COST = 512, 24


def cut_points(doc_ends: np.ndarray, word_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts within a run of documents whose last ids stand before ``doc_ends``, in order, and their penalties."""
    sentences = np.setdiff1d(word_ends[stops], np.concatenate([doc_ends, doc_ends - 1]))
    at = np.union1d(doc_ends, sentences)
    cost = np.where(np.isin(at, doc_ends, assume_unique=True), 0, SENTENCE_PENALTY)
    low = np.concatenate([[0], at[:-1]])
    far = at - low > LONG
    low, high = low[far], at[far]
    n = -(-(high - low) // STEP) - 1  # cuts every STEP ids inside each long stretch
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    want, high = np.repeat(low, n) + nth * STEP, np.repeat(high, n)
    if len(word_ends):
        near = word_ends[np.minimum(np.searchsorted(word_ends, want), len(word_ends) - 1)]
        want = np.where((near - want < STEP) & (near >= want), near, want)
    words = np.unique(want[want < high])
    points = np.concatenate([at, words])
    order = np.argsort(points, kind="stable")
    return points[order], np.concatenate([cost, np.full(len(words), WORD_PENALTY)])[order]


def best_cuts(points: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """The chosen cuts, the last point among them. Neighbouring points are at most a window apart."""
    at = [0, *points]
    powers = []
    p = window
    while p >= LEAST_POWER and p & (p - 1) == 0:
        powers.append(p)
        p //= 2
    place = {x: i for i, x in enumerate(at)}
    best, came = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    key = [0] * len(at)
    find = place.get
    for j in range(1, len(at)):
        x = at[j]
        while x - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - x
        for p in powers:
            k = find(x - p)
            extra = POWER_COST if p < window else 0
            if k is not None and best[k] + extra < cost:
                cost, i = best[k] + extra, k
        cost += penalty[j - 1] + 1
        best[j], came[j] = cost, i
        key[j] = cost = cost + x
        while queue and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


class _Run:
    """Documents in order as one stream of ids."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.doc_ends: list[np.ndarray] = []
        self.word_ends: list[np.ndarray] = []
        self.stops: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_ids: list[int | None], got: Encoded, end_id: int) -> None:
        """A chunk of documents, each followed by the end id; of one that goes on in the next chunk there is no end."""
        ids, ends, words = got.ids, got.ends, got.word_ends
        if not got.goes_on:
            words = words + np.searchsorted(ends, words)
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            self.doc_ids += doc_ids
            self.doc_ends.append(ends + self.n)
        self.ids.append(ids)
        self.word_ends.append(words + self.n)
        self.stops.append(got.stops)
        self.n += len(ids)

    def pieces(self, window: int, first: int, part: int) -> tuple[pa.RecordBatch, int]:
        """The rows of this run and its number of sequences."""
        doc_ends = np.concatenate(self.doc_ends)
        points, cost = cut_points(doc_ends, np.concatenate(self.word_ends), np.concatenate(self.stops))
        cuts = np.array(best_cuts(points.tolist(), cost.tolist(), window))
        ends = np.union1d(doc_ends, cuts)
        starts = np.concatenate([[0], ends[:-1]])
        doc = np.searchsorted(doc_ends, starts, "right")
        sequence = np.searchsorted(cuts, starts, "right")
        doc_starts, cut_starts = np.concatenate([[0], doc_ends[:-1]]), np.concatenate([[0], cuts[:-1]])
        ids = np.concatenate(self.ids).astype("<u4")
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        cols = [
            pa.array(self.doc_ids, pa.int64()).take(pa.array(doc)), starts - doc_starts[doc], ends - starts, crcs,
            (doc_ends - doc_starts)[doc], first + sequence, starts - cut_starts[sequence], np.full(len(doc), part),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_COLUMNS), len(cuts)


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset", "part"]


def _pack(tokenizer: str, end_id: int, window: int):
    def run(batches: Batches) -> Batches:
        enc = Encoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        waiting: deque[int | None] = deque()

        def texts():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    waiting.append(doc_id)
                    yield raw_text(text)

        first, now = 0, _Run()
        for got in enc.chunks(texts()):
            now.add([] if got.goes_on else [waiting.popleft() for _ in got.ends], got, end_id)
            if now.n >= RUN_IDS and not got.goes_on:
                rows, k = now.pieces(window, first, part)
                yield rows
                first, now = first + k, _Run()
        if now.n:
            yield now.pieces(window, first, part)[0]

    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` ids, in ascending ``doc_id`` order.

    Output, a row for each piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``. Every id lies in one piece. Null and
    empty texts are the end id alone. Null ``doc_id`` come first; rows that
    repeat a ``doc_id`` are separate documents in the order of their texts.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kinds = ", ".join(f"{c} long" for c in _COLUMNS)
    pieces = scratch.save(map_arrow(ordered, _pack(tokenizer or default_tokenizer(), end_id, window), kinds), "pieces")
    counts = pieces.groupBy("part").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(starts), "part").select(  # a row for each partition: as many as shuffle partitions
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset"
    )
