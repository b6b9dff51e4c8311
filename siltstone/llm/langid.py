"""Language identification by interpolated Kneser-Ney character models.

Counts of character 4-grams of all learnable texts are gathered for each
language. From them the driver makes one interpolated Kneser-Ney model for each
language and stores them together in sorted arrays of hashed n-grams, each with
a row of log-probabilities, a column for each language. A text belongs to the
language with the lowest cross-entropy for each character. The margins'
temperature and the entropy over which a text is rejected are calibrated on
texts that were left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, map_arrow, plus

ORDER = 4
DISCOUNT = 0.75
#: Languages that one set of models may hold; more raise an error.
MAX_LANGUAGES = 500
#: Documents of a language that calibrate the rejection, at most.
MAX_CALIBRATION = 400
#: Quantile of their entropies from which a limit is taken; it doesn't drift with their number.
RANK = 0.99
UNKNOWN = "und"
NEW = ["lang_pred", "score", "entropy", "rejected"]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        t = np.zeros(0x110000, bool)
        t[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _LETTERS.append(t)
    return _LETTERS[0]


def symbols(text: str | None) -> np.ndarray:
    """Lower-case letters as 16-bit codes, each run of other characters as one space, with spaces at both ends. Empty without letters.

    Letters over U+FFFF share the 2048 codes that UTF-16 keeps for surrogates.
    """
    if not text:
        return np.empty(0, np.uint64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[cp]
    if not letter.any():
        return np.empty(0, np.uint64)
    x = np.where(letter, np.where(cp > 0xFFFF, 0xD800 + cp % 2048, cp), _SPACE)
    x = np.concatenate([[_SPACE], x, [_SPACE]])
    gap = x == _SPACE
    return x[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint64)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """The n-grams that end at each position from the second on, as packed 16-bit codes; short ones are filled with leading zeros."""
    full = np.concatenate([np.zeros(n - 1, np.uint64), x])
    out = np.zeros(len(x), np.uint64)
    for k in range(n):
        out = (out << np.uint64(16)) | full[k : k + len(x)]
    return out[1:]


def _count(batches: Batches) -> Batches:
    """4-gram counts of each language in this partition, merged before they leave it."""
    have: dict[str, list] = {}

    def merged(parts):
        g = np.concatenate([p[0] for p in parts])
        c = np.concatenate([p[1] for p in parts])
        u, at = np.unique(g, return_inverse=True)
        return u, np.bincount(at, c, len(u)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1)
        for lang in set(langs):
            size, wait = 0, []
            for i in np.flatnonzero(langs == lang):
                x = symbols(texts[i].as_py())
                if len(x):
                    wait.append(grams(x, ORDER))
                    size += len(x)
                if size > 500_000:
                    have.setdefault(lang, []).append(np.unique(np.concatenate(wait), return_counts=True))
                    size, wait = 0, []
            if wait:
                have.setdefault(lang, []).append(np.unique(np.concatenate(wait), return_counts=True))
            if len(have.get(lang, ())) > 8:
                have[lang] = [merged(have[lang])]
    for lang, parts in have.items():
        g, c = merged(parts)
        for i in range(0, len(g), 50_000):
            part = g[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(c[i : i + 50_000])], names=["lang", "gram", "n"]
            )


def _kneser_ney(grams4: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Per order, from unigrams: (grams, log-probabilities, contexts, log back-off weights)."""
    levels = [(grams4, counts.astype(float))]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        u, c = np.unique(levels[0][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True)
        levels.insert(0, (u, c.astype(float)))
    out = []
    p_low = None
    for n, (g, c) in enumerate(levels, 1):
        ctx = g >> np.uint64(16)
        contexts, at, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
        total = np.bincount(at, c)
        weight = DISCOUNT * kinds / total
        if n == 1:
            low = np.full(len(g), 1.0 / (len(g) + 1))
        else:
            lower = out[-1]
            low = p_low[np.searchsorted(lower[0], g & np.uint64((1 << (16 * (n - 1))) - 1))]
        p = np.maximum(c - DISCOUNT, 0) / total[at] + weight[at] * low
        out.append((g, np.log(p), contexts, np.log(weight)))
        p_low = p
    return out


@dataclass
class Models:
    """All languages in one set of sorted hash arrays.

    ``tables[n]``: hashes of the n-grams that any language has, their
    log-probabilities in every language; ``backoffs[n]``: hashes of contexts and
    their log back-off weights.
    """

    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    backoffs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray | None = None
    sharpness: float = 20.0
    limits: np.ndarray | None = None

    @staticmethod
    def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
        langs = sorted(counts)
        m = Models(langs)
        single = [_kneser_ney(*counts[k]) for k in langs]
        m.floor = np.array([s[0][3][0] - np.log(len(s[0][0]) + 1) for s in single]) if langs else np.empty(0)
        for n in range(ORDER):
            ctx = np.unique(np.concatenate([s[n][2] for s in single])) if langs else np.empty(0, np.uint64)
            bow = np.zeros((len(ctx), len(langs)))
            for j, s in enumerate(single):
                bow[np.searchsorted(ctx, s[n][2]), j] = s[n][3]
            h = ctx * _SPREAD
            order = np.argsort(h)
            m.backoffs.append((h[order], bow[order]))
            g = np.unique(np.concatenate([s[n][0] for s in single])) if langs else np.empty(0, np.uint64)
            if n:
                mask = np.uint64((1 << (16 * n)) - 1)
                logp = m._lookup(g & mask, n - 1) + m._backoff(g >> np.uint64(16), n)
            else:
                logp = np.tile(m.floor, (len(g), 1))
            for j, s in enumerate(single):
                logp[np.searchsorted(g, s[n][0]), j] = s[n][1]
            h = g * _SPREAD
            order = np.argsort(h)
            m.tables.append((h[order], logp[order]))
        return m

    def _find(self, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        return at, keys[at] == hashes

    def _backoff(self, contexts: np.ndarray, n: int) -> np.ndarray:
        keys, bow = self.backoffs[n]
        at, known = self._find(keys, contexts * _SPREAD)
        return np.where(known[:, None], bow[at], 0.0)

    def _lookup(self, g: np.ndarray, n: int) -> np.ndarray:
        keys, logp = self.tables[n]
        at, known = self._find(keys, g * _SPREAD)
        out = logp[at]
        if not known.all():
            miss = ~known
            if n:
                rest = g[miss]
                out[miss] = self._backoff(rest >> np.uint64(16), n) + self._lookup(rest & np.uint64((1 << (16 * n)) - 1), n - 1)
            else:
                out[miss] = self.floor
        return out

    def entropies(self, text: str | None, block: int = 65_536) -> np.ndarray | None:
        """Nats for each character in each language; None without letters."""
        x = symbols(text)
        if not len(x) or not self.languages:
            return None
        g = grams(x, ORDER)
        total = np.zeros(len(self.languages))
        for i in range(0, len(g), block):
            total -= self._lookup(g[i : i + block], ORDER - 1).sum(axis=0)
        return total / len(g)

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy, and whether the text is rejected."""
        e = self.entropies(text)
        if e is None:
            return UNKNOWN, 0.0, None, True
        j = int(np.argmin(e))
        score = 1 / np.exp(np.clip((e[j] - e) * self.sharpness, -50, 0)).sum()
        return self.languages[j], float(score), float(e[j]), bool(self.limits is not None and e[j] > self.limits[j])

    def calibrate(self, rows: Iterable[tuple[str, str]], margin: float = 1.0) -> None:
        """Fit the sharpness on left-out texts by their log-loss, and set each language's limit ``margin`` nats over the ``RANK`` quantile of such texts."""
        self.limits = np.full(len(self.languages), np.inf)
        got = [(self.languages.index(k), self.entropies(t)) for k, t in rows if k in self.languages]
        got = [(k, e) for k, e in got if e is not None]
        if not got:
            return
        y = np.array([k for k, _ in got])
        e = np.array([e for _, e in got])
        d = e.min(axis=1, keepdims=True) - e
        losses = []
        for s in (1, 2, 5, 10, 20, 50, 100):
            z = np.clip(d * s, -50, 0)
            losses.append((-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean(), s))
        self.sharpness = float(min(losses)[1])
        for k in range(len(self.languages)):
            if (y == k).any():
                self.limits[k] = np.quantile(e[y == k, k], RANK) + margin
        self.limits[np.isinf(self.limits)] = self.limits[np.isfinite(self.limits)].max(initial=-np.inf)


def learnable(doc_id: str = "doc_id") -> Column:
    """Documents whose crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def train(docs: DataFrame, learn: Column | None = None) -> Models:
    """Models of the languages named in ``lang``, from rows where ``learn`` holds.

    Counts cover all these rows but the texts that calibrate the models: of one
    id hash in 64, the ``MAX_CALIBRATION`` least by another hash in each
    language. A language without such texts takes the loosest limit of the
    others; where none has any, nothing is rejected for its entropy. Null
    languages and texts without letters teach nothing.
    """
    use = docs.where("lang is not null and text is not null")
    if learn is not None:
        use = use.where(learn)
    use = use.select("lang", "text", "doc_id")
    aside = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0, F.lit(False))
    by_lang = Window.partitionBy("lang")
    draw = F.xxhash64("doc_id", "lang", "text")
    few = use.where(aside).select("lang", "text", draw.alias("draw"))
    few = few.withColumn("place", F.row_number().over(by_lang.orderBy("draw"))).where(F.col("place") <= MAX_CALIBRATION)
    last = few.groupBy("lang").agg(F.max("draw").alias("last"))
    # Rows that repeat a drawn text under its id stay out of the counts with it.
    rest = use.join(F.broadcast(last), "lang", "left").where(~aside | (draw > F.col("last")))
    counts = map_arrow(rest.select("lang", "text"), _count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.select("lang", "gram", "n").toArrow()
    langs, g, n = (got[c].to_numpy() for c in ("lang", "gram", "n"))
    found = {}
    for lang in sorted(set(langs)):
        mine = langs == lang
        order = np.argsort(g[mine].view(np.uint64))
        found[lang] = (g[mine].view(np.uint64)[order], n[mine][order])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{len(found)} languages; the models hold {MAX_LANGUAGES}")
    models = Models.build(found)
    models.calibrate((r.lang, r.text) for r in few.select("lang", "text", "draw").orderBy("lang", "draw").toLocalIterator())
    return models


def _predict(models: Models, at: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            got = [models.predict(t.as_py()) for t in batch.column(at)]
            cols = list(zip(*got, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[*batch.schema.names, *NEW],
            )

    return run


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """All input columns, and ``lang_pred, score, entropy, rejected`` from ``text`` alone.

    Null texts and texts without letters are ``und`` with score 0 and rejected,
    as is every text where no language was learnt. Input columns with these
    names are replaced.
    """
    docs = docs.drop(*NEW)
    schema = plus(docs, ("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("rejected", "boolean"))
    return map_arrow(docs, _predict(models, docs.columns.index("text")), schema)


def language_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document; rows with crc32(doc_id) mod 5 = 0 are never learnt from."""
    models = train(docs, learnable())
    rows = identify(docs.select("doc_id", "text"), models)
    return rows.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
