"""Embedding of texts by a model or service, in batches inside the tasks.

A model that answers another number of vectors than it got texts is an error and
stops the run. Texts that it can't embed (an answer with NaN or infinite parts,
or an error that says so) are found by halving their batch until one text is
left, so one bad text costs its batch a few more calls and nothing else.
"""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import checkpointed, shipped

BATCH = 64
#: How a service says that a vector has no numbers.
_NOT_A_NUMBER = re.compile(r"unsupported value: (NaN|[+-]Inf)")


class Embedder(Protocol):
    """Texts to vectors of one length; it travels to the tasks, so it must be picklable."""

    dim: int

    def embed(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class ServiceEmbedder:
    """A service that takes ``{"model", "input": [texts]}`` and answers ``{"embeddings": [vectors]}``."""

    def __init__(self, url: str, model: str, dim: int, timeout: float = 60):
        self.url, self.model, self.dim, self.timeout = url, model, dim, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["embeddings"]
        except urllib.error.HTTPError as e:
            raise ValueError(f"{e.code}: {e.read(2000).decode(errors='replace')}") from e


class LengthMismatch(ValueError):
    """A model's answer doesn't fit what it was asked."""


def vectors(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, reason) of each text."""
    if not texts:
        return []
    try:
        found = [[float(x) for x in v] for v in embedder.embed(texts)]
    except Exception as e:
        if not _NOT_A_NUMBER.search(str(e)):
            raise
        found, reason = None, str(e)
    if found is not None:
        if len(found) != len(texts):
            raise LengthMismatch(f"{len(found)} vectors for {len(texts)} texts")
        if wrong := next((len(v) for v in found if len(v) != embedder.dim), None):
            raise LengthMismatch(f"a vector of {wrong} parts where {embedder.dim} were expected")
        if all(math.isfinite(x) for v in found for x in v):
            return [(v, None) for v in found]
        reason = "unsupported value: " + next("NaN" if x != x else "+Inf" if x > 0 else "-Inf" for v in found for x in v if not math.isfinite(x))
    if len(texts) == 1:
        return [(None, reason)]
    half = len(texts) // 2
    return vectors(embedder, texts[:half]) + vectors(embedder, texts[half:])


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = BATCH) -> DataFrame:
    """``id, embedding, error`` of rows ``id, text``; null texts count as empty. Computed anew each time it is read."""
    shipped(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                got = vectors(embedder, [x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())], names=["id", "embedding", "error"]
                )

    return rows.select("id", F.col(text).alias("text")).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, embedding array<float>, error string")


def repair(chunks: DataFrame, points: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, points, failures ``id, error``): unbound chunks get a point of their own id.

    A chunk whose text can't be embedded stays as it is and is reported; the
    others are bound. Points that no chunk refers to any more go.
    """
    from siltstone.operators import maintenance as M

    todo = M.unbound(chunks)
    done = checkpointed(embedded(todo, embedder))  # read three times
    good = done.where("error is null")
    bound = chunks.join(good.select("id", F.lit(True).alias("_bound")), "id", "left")
    new = todo.join(good.select("id", "embedding"), "id").select(F.col("id").alias("point_id"), "embedding", F.col("metadata").alias("payload"))
    out = bound.withColumn("point_id", F.when(F.col("_bound"), F.col("id")).otherwise(F.col("point_id"))).select(*chunks.columns)
    old = todo.join(good.select("id"), "id", "left_semi").select("point_id").where("point_id is not null")
    still = out.select("point_id").where("point_id is not null").distinct()
    gone = old.join(still, "point_id", "left_anti").unionByName(new.select("point_id"))
    kept = points.join(gone.distinct(), "point_id", "left_anti").select("point_id", "embedding", "payload")
    return out, kept.unionByName(new), done.where("error is not null").select("id", "error")
