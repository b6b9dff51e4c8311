"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are exact. For a bounded block of queries:

1. Every row is scored and each query gets a histogram of its scores.
2. The bin that holds its k-th highest score is refined, until it is one score
   wide. A task reports only its highest bins that hold k of its own scores:
   lower bins cannot hold the k-th score of all.
3. A last pass keeps the scores over the k-th value and, of those equal to it,
   the smallest ids that fill the k places.

Scores are recomputed in each pass instead of being stored. Blocks of queries
are of bounded size and so are the histograms; the rows are never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, Scratch, map_arrow

SCALE = 1024
#: Queries in a block, and bits of a score that one round of histograms settles.
BLOCK, BITS = 4096, 9
#: The largest score that fits 64 bits.
MOST = 2**63 - 1


def limit(d: int) -> int:
    """Integers up to which no sum of d products leaves 64 bits; vectors with a larger one are out of range."""
    return math.isqrt(MOST // d)


def integer_vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of floor(1024 * x)) of each length; rows with null, NaN, infinite or out-of-range parts are left out."""
    rows = pa.table({"id": ids, "v": vectors}).filter(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)))
    if not rows.num_rows:
        return
    got, lists = rows["id"].combine_chunks(), rows["v"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        if d == 0:
            continue
        pick = pa.array(np.flatnonzero(lengths == d))
        flat = pc.list_flatten(lists.take(pick)).cast(pa.float64())
        m = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # nulls turn into NaN
        m = np.floor(m * SCALE)
        ok = np.isfinite(m).all(axis=1) & (np.abs(m) <= limit(d)).all(axis=1)
        if ok.any():
            yield got.take(pick).to_numpy(zero_copy_only=False)[ok], m[ok]


def _scores(ids: np.ndarray, m: np.ndarray, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer scores (queries x rows), and where a row has the query's own id."""
    top = np.abs(m).max() * np.abs(q).max() * m.shape[1]
    s = (q @ m.T).astype(np.int64) if top < 2**53 else q.astype(np.int64) @ m.T.astype(np.int64)
    return s, own[:, None] == ids[None, :]


def _histograms(queries: dict, low: dict, shift: int, bits: int, k: int):
    """Counts of scores in 2**bits bins of width 2**shift from each query's lower edge; scores over all bins count in the last plus one."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {d: np.zeros((len(v[0]), 2**bits + 1), np.int64) for d, v in queries.items()}
        for batch in batches:
            for ids, m in integer_vectors(batch.column(0), batch.column(1)):
                d = m.shape[1]
                if d not in queries:
                    continue
                own, q = queries[d]
                step = max(64, 2**20 // len(own))  # bounds the score matrix
                for i in range(0, len(ids), step):
                    s, same = _scores(ids[i : i + step], m[i : i + step], own, q)
                    over = s.view(np.uint64) - low[d].view(np.uint64)[:, None]  # modulo 2**64: right wherever s isn't lower
                    at = np.minimum(over >> np.uint64(shift), np.uint64(2**bits)).astype(np.int64)
                    use = (s >= low[d][:, None]) & ~same
                    row = np.broadcast_to(np.arange(len(own))[:, None], at.shape)
                    flat = row[use] * (2**bits + 1) + at[use]
                    total[d] += np.bincount(flat, minlength=total[d].size).reshape(total[d].shape)
        for d, h in total.items():
            above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h  # scores in higher bins
            r, b = np.nonzero((h > 0) & (above < k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), d)), pa.array(r), pa.array(b), pa.array(h[r, b])], names=["dim", "q", "bin", "n"]
            )

    return run


def _matches(queries: dict, kth: dict, k: int):
    """Each task's scores over the k-th value, and of those equal to it the k smallest ids."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for ids, m in integer_vectors(batch.column(0), batch.column(1)):
                d = m.shape[1]
                if d not in queries:
                    continue
                own, q = queries[d]
                step = max(64, 2**20 // len(own))  # bounds the score matrix
                found = []
                for i in range(0, len(ids), step):
                    s, same = _scores(ids[i : i + step], m[i : i + step], own, q)
                    r, c = np.nonzero((s >= kth[d][:, None]) & ~same)
                    found.append((r, ids[i + c], s[r, c]))
                r, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((v, -s, r))
                r, v, s = r[order], v[order], s[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[r[keep]]), pa.array(v[keep]), pa.array(s[keep])], names=["query_id", "vec_id", "score"]
                )

    return run


def _kth(rows: DataFrame, queries: dict, k: int) -> dict:
    """For each query its k-th highest score, or its lowest if it has fewer."""
    largest = rows.select(F.max(F.array_max(F.transform("embedding", lambda x: F.when(F.abs(x) * SCALE <= limit(1), F.abs(x)))))).first()[0]
    part = {d: min(limit(d), int((largest or 0) * SCALE) + 1) for d in queries}
    bound = min(MOST, max(int(np.abs(q).sum(axis=1).max()) * part[d] for d, (_, q) in queries.items()) + 1)
    width = max(BITS, (2 * bound + 1).bit_length())
    low = {d: np.full(len(o), -bound, np.int64) for d, (o, _) in queries.items()}
    above = {d: np.zeros(len(o), np.int64) for d, (o, _) in queries.items()}  # scores over the current bin
    shift = width
    while shift > 0:
        bits = min(BITS, shift)
        shift -= bits
        counted = map_arrow(rows, _histograms(queries, low, shift, bits, k), "dim long, q long, bin long, n long")
        got = counted.groupBy("dim", "q", "bin").agg(F.sum("n").alias("n")).toPandas()
        for d, (own, _) in queries.items():
            h = np.zeros((len(own), 2**bits + 1), np.int64)
            x = got[got["dim"] == d]
            h[x["q"].to_numpy(), x["bin"].to_numpy()] = x["n"].to_numpy()
            over = np.cumsum(h[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
            full = over[:, : 2**bits] >= k
            at = np.where(full.any(axis=1), 2**bits - 1 - np.argmax(full[:, ::-1], axis=1), 0)
            low[d] = (low[d].view(np.uint64) + (at.astype(np.uint64) << np.uint64(shift))).view(np.int64)
    return low


def top_k(rows: DataFrame, is_query, k: int = 10, block: int = BLOCK) -> DataFrame:
    """Each query's k highest integer inner products over all other rows; ties go to smaller ids.

    Input: ``vec_id`` and ``embedding``; ``is_query`` is a condition on
    ``vec_id``. Output: ``query_id, rank, vec_id, score``. Null ids, null or
    empty vectors and vectors with null, NaN, infinite or out-of-range parts
    take no part; vectors meet only those of their own length. Of rows that
    repeat a query's id one is the query, the least by value, and all are its own; rows that
    repeat another id are each a candidate. Queries without candidates and
    empty tables give no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    scratch = Scratch(spark, "topk")
    asked = rows.where(is_query & F.col("vec_id").isNotNull())
    blocks = max(1, -(-asked.count() * 5 // (4 * block)))
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        queries = {}
        for ids, m in integer_vectors(own["vec_id"].combine_chunks(), own["embedding"].combine_chunks()):
            order = np.lexsort((*m.T[::-1], ids))
            ids, m = ids[order], m[order]
            first = np.r_[True, ids[1:] != ids[:-1]]
            queries[m.shape[1]] = (ids[first], m[first])
        if not queries:
            continue
        kth = _kth(rows, queries, k)
        found = map_arrow(rows, _matches(queries, kth, k), "query_id long, vec_id long, score long")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        parts.append(scratch.save(best.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "block"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
