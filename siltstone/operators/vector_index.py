"""An inverted-file index of vectors with product-quantised residuals, for cosine.

``build`` fits centroids and codebooks on a bounded sample of ``SAMPLE`` vectors
(those with the least hashes of their ids), then places every vector: its list
is that of the nearest centroid, its code the nearest entries of the codebooks
to what is left of it. How many lists a search probes is measured while
building: the fewest for which sampled queries find ``TARGET`` of their exact
neighbours. A search reads the codes of the probed lists, keeps the best
candidates of each query by code, and scores these by their whole vectors, so
scores are exact and only neighbours can be missed; ``exact=True`` scans all.

Filters apply inside the lists, before candidates are cut, and widen the probe
by the share of vectors that they leave.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import shipped
from siltstone.operators import retrieval as R

#: Vectors that centroids and codebooks are fitted on, and sampled queries that the probe is measured by.
SAMPLE, MEASURED = 20_000, 200
TARGET = 0.95
#: Most lists, entries of a codebook, rounds of Lloyd's algorithm.
LISTS, ENTRIES, ROUNDS = 4096, 256, 12
#: Candidates by code for each result.
OVERFETCH = 8
#: Bytes of a row group of the stored lists.
GROUP_BYTES = 4 << 20


def _units(lists: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors; null, zero and non-finite vectors and those of another length are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    d = d or max(0, int(sizes.max(initial=0)))
    at = np.flatnonzero((sizes == d) & (sizes > 0))
    if not len(at):
        return at, np.empty((0, max(d, 1)))
    m = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
    norm = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], m[ok] / norm[ok][:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres of rows; an empty cluster takes the row that is worst served."""
    rnd = np.random.default_rng(seed)
    centres = x[rnd.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            far = ((x - centres[near]) ** 2).sum(axis=1)
            centres[n == 0] = x[np.argsort(-far, kind="stable")[: int((n == 0).sum())]]
    return centres


@dataclass
class Quantiser:
    """Centroids, and codebooks of the parts of residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fitted(cls, x: np.ndarray, lists: int, seed: int = 7) -> Quantiser:
        centres = _lloyd(x, lists, seed)
        rest = x - centres[_nearest(x, centres)]
        width = next(w for w in (8, 4, 2, 1) if x.shape[1] % w == 0)
        return cls(centres, [_lloyd(rest[:, i : i + width], ENTRIES, seed + i) for i in range(0, x.shape[1], width)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code (a byte for each part) of each row."""
        near = _nearest(x, self.centres)
        rest, w = x - self.centres[near], self.books[0].shape[1]
        return near, np.stack([_nearest(rest[:, i * w : (i + 1) * w], b).astype(np.uint8) for i, b in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x parts x entries: what each entry adds to the product with a query."""
        w = self.books[0].shape[1]
        out = np.zeros((len(q), len(self.books), ENTRIES))
        for i, b in enumerate(self.books):
            out[:, i, : len(b)] = q[:, i * w : (i + 1) * w] @ b.T
        return out


def _places(quantiser: Quantiser):
    d = quantiser.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch.column(batch.num_columns - 1), d)
            near, codes = quantiser.coded(x)
            pick = pa.array(at)
            kept = [c.take(pick) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "list", "code"])

    return run


def _candidates(names: list, q: np.ndarray, probes: np.ndarray, quantiser: Quantiser, n: int):
    """Each task's n best of every query by code, over the lists that the query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, near = quantiser.tables(q), q @ quantiser.centres.T
        asks: dict[int, np.ndarray] = {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}
        for batch in batches:
            lists = batch.column(1).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            rows, who, scores = [], [], []
            for c in np.unique(lists).tolist():
                of, mine = asks.get(c, np.empty(0, np.int64)), np.flatnonzero(lists == c)
                for i in range(0, len(of), max(1, 2**22 // max(1, len(mine)))):
                    some = of[i : i + max(1, 2**22 // max(1, len(mine)))]
                    s = near[some, c][:, None] + sum(tables[some, j][:, codes[mine, j]] for j in range(codes.shape[1]))
                    if len(mine) > n:
                        low = np.partition(s, len(mine) - n, axis=1)[:, len(mine) - n][:, None]
                        a, b = np.nonzero(s >= low)
                    else:
                        a, b = np.divmod(np.arange(s.size), len(mine))
                    rows.append(mine[b])
                    who.append(some[a])
                    scores.append(s[a, b])
            if not rows:
                continue
            r, w, s = np.concatenate(rows), np.concatenate(who), np.concatenate(scores)
            order = np.lexsort((-s, w))
            r, w, s = r[order], w[order], s[order]
            keep = np.arange(len(w)) - np.searchsorted(w, w) < n
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in w[keep].tolist()]), batch.column(0).take(pa.array(r[keep])), batch.column(1).take(pa.array(r[keep])), pa.array(s[keep])], names=["query_id", "id", "list", "score"]
            )

    return run


class VectorIndex:
    """The index of one folder; ``points`` have ``id``, ``embedding`` and any columns to filter by."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        row = spark.read.text(f"{self.root}/about").first()
        about = json.loads(row[0])
        self.probe, self.recall = about["probe"], about["recall"]
        parts = {r["part"]: np.array(r["rows"]) for r in spark.read.parquet(f"{self.root}/quantiser").collect()}  # bounded by LISTS and ENTRIES
        self.quantiser = Quantiser(parts[-1], [parts[i] for i in range(len(parts) - 1)])
        self.points = spark.read.parquet(f"{self.root}/points")  # listed once for all searches

    @classmethod
    def build(cls, points: DataFrame, root: str, lists: int | None = None, k: int = R.DEFAULT_LIMIT, target: float = TARGET) -> VectorIndex:
        """Fit, place every vector, and measure how many lists to probe for the k nearest.

        Vectors that are null, zero or not finite match nothing and are left
        out; the length of most sampled vectors is the index's, others match
        nothing either. A table without any other vector can't be indexed.
        """
        spark = points.sparkSession
        shipped(spark)
        rows = points.where("id is not null and embedding is not null and size(embedding) > 0").withColumn("embedding", F.col("embedding").cast("array<double>"))
        taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("embedding").cast("array<float>").alias("embedding")).toArrow()
        sizes = pc.list_value_length(taken["embedding"].combine_chunks()).to_numpy(zero_copy_only=False) if taken.num_rows else np.empty(0, int)
        if not len(sizes):
            raise ValueError("no vectors to index")
        at, x = _units(taken["embedding"].combine_chunks(), int(np.bincount(sizes).argmax()))
        if not len(x):
            raise ValueError("no vectors to index")
        lists = lists or int(np.clip(np.sqrt(rows.count()), 1, LISTS))
        quantiser = Quantiser.fitted(x, lists)
        rest = [c for c in rows.columns if c != "embedding"]
        kind = ", ".join(f"`{n}` {t}" for n, t in rows.select(*rest, "embedding").dtypes)
        placed = rows.select(*rest, "embedding").mapInArrow(_places(quantiser), f"{kind}, list int, code binary")
        placed = placed.withColumn("embedding", F.col("embedding").cast("array<float>"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # A list's rows lie together, a range may split a long list. Files and their row groups span few lists and are left
        # out by the lists' bounds; a folder for each list would be listed by a task each, whose answers go to the driver.
        placed.repartitionByRange(n, "list", F.xxhash64("id")).sortWithinPartitions("list").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{root}/points")
        books = [(-1, quantiser.centres.tolist()), *((i, b.tolist()) for i, b in enumerate(quantiser.books))]
        spark.createDataFrame(books, "part int, rows array<array<double>>").coalesce(1).write.parquet(f"{root}/quantiser")
        asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:MEASURED])], "query_id long, embedding array<double>")
        about = {"probe": len(quantiser.centres), "recall": 1.0}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{root}/about")
        out = cls(spark, root)
        want = {(r.query_id, r.id) for r in R.vector_hits(out.points, asked, k).select("query_id", "id").collect()}  # MEASURED * k rows
        probe, recall = 1, 0.0
        while True:
            got = out.search(asked, k, probe=probe).select("query_id", "id").collect()
            recall = len(want & {(r.query_id, r.id) for r in got}) / max(1, len(want))
            if recall >= target or probe >= len(quantiser.centres):
                break
            probe = min(2 * probe, len(quantiser.centres))
        out.probe, out.recall = probe, recall
        spark.createDataFrame([(json.dumps({"probe": probe, "recall": recall}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/about")
        return out

    def search(self, queries: DataFrame, k: int = R.DEFAULT_LIMIT, where: Column | None = None, probe: int | None = None, exact: bool = False) -> DataFrame:
        """The k nearest of each query ``query_id, embedding``: ``query_id, id, score, rank``; ``where`` is a condition on the points' columns.

        Queries go to the tasks in blocks of at most ``retrieval.BLOCK``. Those
        with null, zero or non-finite vectors or another length match nothing.
        Ties go to smaller ids.
        """
        points = self.points if where is None else self.points.where(where)
        if exact:
            return R.vector_blocks(points, queries, k)
        shipped(self.spark)
        lists = len(self.quantiser.centres)
        wide = probe or self.probe
        if where is not None:
            share = points.count() / max(1, self.points.count())
            wide = lists if share * lists < 1 else min(lists, int(np.ceil(wide / share)))
        kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *points.schema)}
        blocks = max(1, -(-queries.count() // R.BLOCK))
        parts = []
        for i in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", F.col("embedding").cast("array<double>").alias("e")).toArrow()
            at, q = _units(asked["e"].combine_chunks(), self.quantiser.centres.shape[1]) if asked.num_rows else (np.empty(0, int), None)
            if not len(at):
                continue
            names = asked["query_id"].take(pa.array(at)).to_pylist()
            near = q @ self.quantiser.centres.T
            probes = np.argsort(-near, axis=1, kind="stable")[:, :wide]
            read = points.where(F.col("list").isin(np.unique(probes).tolist())) if wide < lists else points
            n = max(k, OVERFETCH * k)
            schema = f"query_id {kinds['query_id']}, id {kinds['id']}, list int, score double"
            best = R.top(read.select("id", "list", "code").mapInArrow(_candidates(names, q, probes, self.quantiser, n), schema), n).drop("rank", "score")
            unit = self.spark.createDataFrame([(name, v.tolist()) for name, v in zip(names, q, strict=True)], f"query_id {kinds['query_id']}, unit array<double>")
            whole = best.join(read.select("id", "list", "embedding"), ["list", "id"]).join(R.small(unit), "query_id")
            parts.append(_scored(whole))
        if not parts:
            return self.spark.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")
        return R.top(reduce(DataFrame.unionByName, parts), k)


def _scored(rows: DataFrame) -> DataFrame:
    """Exact cosines of ``unit`` and ``embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (pc.list_flatten(batch.column(c)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (2, 3))
            s = (a * b).sum(axis=1) / np.sqrt((b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["query_id", "id", "score"])

    kinds = dict(rows.dtypes)
    return rows.select("query_id", "id", "unit", "embedding").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
