"""Embedding whitening with moments merged by Chan's formula.

1. Each partition has the count, the mean and the centred scatter of its rows;
   ``treeReduce`` merges them in pairs: scatters add up, with the outer product
   of the difference of the means weighted by n1 * n2 / (n1 + n2). Entries are
   whole numbers, so a mean is kept as its exact sum and differences of means
   are exact before their one rounding: a large offset costs no digits.
2. The driver finds the eigenvectors of one matrix of dimension x dimension.
3. A second pass merges the moments of the whitened rows in the same way and
   compares their covariance with the identity; a third one returns the rows.

Chan, Golub, LeVeque, "Updating formulae and a pairwise algorithm for computing
sample variances" (1979).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, map_arrow

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Partial moments that meet in one step of the tree.
FAN_IN = 8
#: Rows of a returned batch.
ROWS = 1024
_SAFE = 2**62


def whole_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of floor(64 * c) + 1000000) of each length.

    Left out: null and empty vectors, those with null, NaN or infinite entries,
    and those with an entry whose whole number leaves 62 bits.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64())
        m = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, d) * float(SCALE))  # nulls turn into NaN
        with np.errstate(invalid="ignore"):
            ok = (np.abs(m) < _SAFE - OFFSET).all(axis=1)
        if ok.any():
            yield at[ok], m[ok].astype(np.int64) + OFFSET


def spread(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exact; Python's whole numbers where 64 bits could be too few."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(t)) for t in total), default=0))
    if most < _SAFE // 2:
        return x * np.int64(n) - np.array([int(t) for t in total], np.int64)
    return x.astype(object) * n - total


@dataclass
class Moments:
    """Count, sum (exact) and centred scatter of rows of whole numbers."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n = len(x)
        total = x.astype(object).sum(axis=0) if int(np.abs(x).max()) * n >= _SAFE else x.sum(axis=0).astype(object)
        c = spread(x, n, total).astype(np.float64) / n
        return cls(n, total, c.T @ c)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = (other.total * self.n - self.total * other.n).astype(np.float64) / (self.n * other.n)
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass
class RealMoments:
    """Count, mean and centred scatter of rows of real numbers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> RealMoments:
        mean = x.mean(axis=0)
        c = x - mean
        return cls(len(x), mean, c.T @ c)

    def merged(self, other: RealMoments) -> RealMoments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return RealMoments(n, self.mean + apart * (other.n / n), scatter)


def merge(a: dict, b: dict) -> dict:
    """Moments of each vector length."""
    out = dict(a)
    for d, m in b.items():
        out[d] = out[d].merged(m) if d in out else m
    return out


def gathered(rows: DataFrame, moments: Callable[[np.ndarray], object]) -> dict:
    """The merged moments of all vectors of each length."""

    def run(batches: Batches) -> Batches:
        have: dict = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                have = merge(have, {x.shape[1]: moments(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(have)], pa.binary())], names=["moments"])

    parts = map_arrow(rows.select("embedding"), run, "moments binary").rdd.map(lambda r: pickle.loads(r[0]))
    n = parts.getNumPartitions()
    return parts.treeReduce(merge, max(2, math.ceil(math.log(n, FAN_IN)))) if n else {}


@dataclass
class Whitening:
    """What whitens the vectors of one length: exact sums, components by falling eigenvalue, shares of the variance."""

    n: int
    total: np.ndarray
    components: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, m: Moments, k: int) -> Whitening:
        v = m.scatter / m.n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-values, kind="stable")[:k]
        values, vectors = values[order], vectors[:, order]
        lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
        vectors = vectors * np.where(lead < 0, -1.0, 1.0)
        values = np.where(values > len(v) * 8 * np.finfo(float).eps * max(values.max(), 0.0), values, 0.0)
        trace = float(np.trace(v))
        with np.errstate(divide="ignore"):
            scale = np.where(values > 0, 1 / np.sqrt(values), np.nan)
        return cls(m.n, m.total, vectors, scale, values / trace if trace > 0 else np.zeros(len(values)))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        return (spread(x, self.n, self.total).astype(np.float64) / self.n) @ self.components * self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - total) ** 2; null beyond 63 bits."""
        c = spread(x, self.n, self.total)
        if c.dtype != object and x.shape[1] * float(np.abs(c).max()) ** 2 < _SAFE:
            return (c * c).sum(axis=1).tolist()
        exact = (c.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def _identity_error(m: RealMoments | None) -> float | None:
    if m is None or not len(m.mean):
        return None
    return float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every vector's coordinates along the leading components, each of variance one.

    Input: ``vec_id`` and ``embedding``; other columns are ignored. Output, a row
    for each vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``. Left out: null and empty vectors and those with
    null, NaN or infinite entries, or with entries over 2**56. Null ids stay,
    rows that repeat count and are returned each. Vectors of different lengths
    are fitted apart; a length under ``components`` has as many components as
    entries. Components without variance (equal or few rows) have a null
    ``whitened``, ``explained`` 0, and no part in ``identity_error``, which is
    null if there are no others. A deviation beyond 63 bits is null. Equal
    eigenvalues have some orthonormal basis, one for all rows. An empty table
    gives no rows.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fits = {d: Whitening.of(m, components) for d, m in gathered(rows, Moments.of).items()}
    live = {d: np.isfinite(w.scale) for d, w in fits.items()}
    second = gathered(rows, lambda x: RealMoments.of(fits[x.shape[1]].apply(x)[:, live[x.shape[1]]]))
    errors = {d: _identity_error(second.get(d)) for d in fits}
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, x in whole_vectors(batch.column(1)):
                d = x.shape[1]
                fit, k = fits[d], fits[d].components.shape[1]
                for i in range(0, len(at), ROWS):
                    part = x[i : i + ROWS]
                    each = np.repeat(np.arange(len(part)), k)
                    white = fit.apply(part).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at[i : i + ROWS][each])),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                            pa.array(np.full(len(each), fit.n, np.int64)),
                            pa.array(fit.deviations(part), pa.int64()).take(pa.array(each)),
                            pa.array(white, mask=np.isnan(white)),
                            pa.array(np.tile(fit.explained, len(part))),
                            pa.array([errors[d]] * len(each), pa.float64()),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return map_arrow(rows, run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
