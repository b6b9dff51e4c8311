"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise
sum is 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so a document costs
time linear in its features.

The model is fitted on the driver on at most ``max_rows`` labelled documents, a
documented bound; every document is scored on its whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, map_arrow, plus

BUCKETS = 2048
FACTORS = 8
MAX_ROWS = 6000
STATS = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "symbols", "digits", "punctuation", "space",
    "ends_in_symbol", "distinct_words", "same_as_last", "repeated_pairs", "commonest_word", "short_lines",
    "repeated_lines", "bars", "exclaims", "letters", "stated_chars",
)
N_FEATURES = BUCKETS + len(STATS)
_KNOWN: dict[str, int] = {}
_SYMBOLS = frozenset("#$%&*+/<=>@\\^_`{|}~")
_LATIN = np.array([chr(i) in _SYMBOLS for i in range(128)])
_PUNCT = np.array([chr(i) in ".,;:!?'\"()-" for i in range(128)])


def _bucket(word: str) -> int:
    b = _KNOWN.get(word)
    if b is None:
        b = zlib.crc32(word.encode()) % BUCKETS
        if len(_KNOWN) < 300_000:
            _KNOWN[word] = b
    return b


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words of unit length, then structure statistics and the stated length."""
    t = text or ""
    words = t.split()
    n, chars = len(words), len(t)
    stats = np.zeros(len(STATS))
    index, value = np.empty(0, np.int64), np.empty(0)
    if n:
        at = np.fromiter(map(_bucket, t.lower().split()), np.int64)
        counts = np.bincount(at, minlength=BUCKETS)
        index = np.flatnonzero(counts)
        value = np.log1p(counts[index])
        value /= np.sqrt((value * value).sum())
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = cp[cp < 128]
        upper = sum(map(str.isupper, t)) if not t.isascii() else int(((low >= 65) & (low <= 90)).sum())
        names, codes = np.unique(np.fromiter(map(hash_of, words), np.int64, n), return_inverse=True)
        lines = t.split("\n")
        pairs = codes[1:].astype(np.int64) * len(names) + codes[:-1]
        stats[:] = (
            np.log1p(chars), np.log1p(n), np.log1p(len(lines)), min(40.0, chars / n), upper / chars, _LATIN[low].sum() / chars,
            ((low >= 48) & (low <= 57)).sum() / chars, _PUNCT[low].sum() / chars, ((low <= 32).sum()) / chars,
            sum(w[-1] in _SYMBOLS for w in words) / n, len(names) / n, (codes[1:] == codes[:-1]).sum() / n,
            1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0, np.bincount(codes).max() / n,
            sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
            t.count("|") / n, t.count("!!") / n, 1 - len(low) / chars + ((low >= 65).sum()) / chars, 0.0,
        )
    stats[-1] = np.log1p(max(0, n_chars if n_chars is not None else chars))
    return np.concatenate([index, np.arange(BUCKETS, N_FEATURES)]), np.concatenate([value, stats])


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@dataclass
class FactorisationMachine:
    """Weights for features whose statistics part is standardised by ``mean`` and ``scale``."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def untrained() -> FactorisationMachine:
        k = len(STATS)
        return FactorisationMachine(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)), np.zeros(k), np.ones(k))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        x = value.copy()
        k = len(self.mean)
        x[-k:] = np.clip((x[-k:] - self.mean) / self.scale, -4, 4)
        v = self.v[index] * x[:, None]
        s = v.sum(axis=0)
        z = self.bias + self.w[index] @ x + 0.5 * ((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[list[int], list[float], int]], epochs: int = 30, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss over a bounded number of rows (features, values, label)."""
    m = FactorisationMachine.untrained()
    labels = {y for *_, y in rows}
    if not rows:
        return m
    if len(labels) == 1:
        m.bias = 5.0 if labels == {1} else -5.0
        return m
    k = len(STATS)
    raw = np.array([v[-k:] for _, v, _ in rows])
    m.mean, m.scale = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    x = np.zeros((len(rows), N_FEATURES), np.float32)
    for i, (idx, val, _) in enumerate(rows):
        x[i, idx] = val
    x[:, -k:] = np.clip((raw - m.mean) / m.scale, -4, 4)
    y = np.array([r[2] for r in rows], np.float32)
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size, decay = 0, 128, 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), size):
            b = x[order[i : i + size]]
            s = b @ params[2]
            b2 = b * b
            z = params[0] + b @ params[1] + 0.5 * ((s * s).sum(axis=1) - (b2 @ (params[2] ** 2)).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[i : i + size]]) / len(b)
            gb2 = b2.T @ g
            grads = [np.array([g.sum()]), b.T @ g + decay * params[1], b.T @ (g[:, None] * s) - params[2] * gb2[:, None] + decay * params[2]]
            step += 1
            for p, d, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    m.bias, m.w, m.v = float(params[0][0]), params[1].astype(float), params[2].astype(float)
    return m


def _featurise(batches: Batches) -> Batches:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(3)
        got = [features(t.as_py(), n) for t, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64())), labels],
            names=["doc_id", "index", "value", "label"],
        )


def _score(model: FactorisationMachine, at: list[int]):
    text, chars = at

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n = batch.column(chars).to_pylist()
            s = [model.score(*features(t.as_py(), c)) for t, c in zip(batch.column(text), n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % by


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled documents, those whose ids have the least hashes.

    ``learn`` is a condition on the labels' ``doc_id``. Labels other than 0 and
    1 and null ids are ignored; of labels that disagree for an id the lower
    holds, and of documents that repeat an id one is learnt from. No usable
    labels: every score is 0.5.
    """
    use = labels.where("doc_id is not null and quality in (0, 1)")
    if learn is not None:
        use = use.where(learn)
    use = use.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    rows = own.join(F.broadcast(use), "doc_id").select("doc_id", "text", "n_chars", "label")  # max_rows ids at most
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "n_chars"), "text", "n_chars")
    rows = rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth")
    got = map_arrow(rows, _featurise, "doc_id long, index array<long>, value array<double>, label int").toArrow()
    order = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "label", "value", "index")), strict=True))
    return fit([(i, v, y) for _, y, v, i in order])


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """All input columns and ``score``, from ``text`` and ``n_chars`` alone.

    Null and empty texts have no words and all statistics 0; they get a score
    like any other. A null ``n_chars`` is replaced by the text's length. An
    input column named ``score`` is replaced.
    """
    docs = docs.drop("score")
    at = [docs.columns.index("text"), docs.columns.index("n_chars")]
    return map_arrow(docs, _score(model, at), plus(docs, ("score", "double")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; rows with crc32(doc_id) mod 3 = 1 are never learnt from."""
    model = train(docs, labels, remainder("doc_id", 3) != 1)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    return score_documents(rows, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
