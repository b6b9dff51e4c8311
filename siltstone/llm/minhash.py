"""MinHash near-deduplication with exact links.

1. One pass over the texts gives each document its set size, 128 universal hash
   minima cut to one byte each (the signature) and 32 band keys of four minima.
   Documents with the same words share one representative.
2. Band buckets are not expanded into pairs. Every member is compared with the
   least member of its bucket: first by signature, then on full shingle sets.
3. Components of these links are found with large-star and small-star.
4. Only members of one bucket whose components still differ are compared with
   each other. The Jaccard distance is a metric, so the distances to the shared
   bucket centre rule out most of these pairs; so do set sizes and, in crowded
   buckets, the shingles that many there have, as pairs that share a rare one are
   found by it. Bounds from full sets are exact.

What is missed: a pair at a similarity of exactly 0.75 shares no bucket with
probability (1 - 0.75**4)**32 = 5e-6, more similar pairs less often. Pairs whose
signatures agree on under 0.55 are taken for far apart without their sets, and
their distance is bounded by that estimate; at 0.75 that is 5.2 standard
deviations away, about 1e-7 of such pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import shipped
from siltstone.llm.common import Batches, Scratch, map_arrow
from siltstone.llm.components import connected_components

WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signatures this far under the threshold are about five standard deviations away.
SIGNATURE_SLACK = 0.2
#: Pairs of one bucket over which its documents' unshared shingles are counted first.
CROWDED = 2000
#: Bytes of sets that leave a task at once.
FLUSH = 4_000_000
#: A shingle is rare if no more of these documents have it.
RARE = 16
#: Shingles of crowded buckets' documents that are counted together, about.
RANGE = 100_000

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 2**64, HASHES, dtype=np.uint64) | _U(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**64, WORDS, dtype=np.uint64) | _U(1)
_ROW = _rng.integers(1, 2**64, ROWS, dtype=np.uint64) | _U(1)
_BAND = _rng.integers(1, 2**64, BANDS, dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles.

    Fewer than five words: the whole sequence as one shingle. No words: empty.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=np.uint64)
    n = len(h)
    if n < WORDS:
        tagged = np.append(h * _PLACE[:n], np.array([n], np.uint64) * _MIX)
        return _finish(tagged.sum(dtype=np.uint64, keepdims=True))
    x = h[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        x = x + h[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_finish(x))


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each universal hash a * x + b mod 2**64 over the set."""
    low = None
    for i in range(0, len(shingles), block):
        v = _A[:, None] * shingles[None, i : i + block]
        v += _B[:, None]
        m = v.min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return low


def _signatures(batches: Batches) -> Batches:
    for batch in batches:
        ids, fps, sizes, sigs, bands = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            s = shingle_set(words)
            ids.append(doc_id)
            sizes.append(len(s))
            if len(s):
                m = minima(s)
                fps.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sigs.append((_finish(m) >> _U(56)).astype(np.uint8).tobytes())
                keys = (m.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND
                bands.append(_finish(keys).view(np.int64))
            else:
                fps.append(None)
                sigs.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(fps, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(sigs, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                batch.column(2),
            ],
            names=["doc_id", "fp", "n_shingles", "sig", "bands", "text_key"],
        )


def _sets(batches: Batches) -> Batches:
    """The set of each text, some megabytes of sets at a time."""
    for batch in batches:
        ids, sets, size = [], [], 0
        last = batch.num_rows - 1
        for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            ids.append(doc_id)
            sets.append(shingle_set(words_of(text.as_py())).tobytes())
            size += len(sets[-1])
            if size > FLUSH or i == last:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
                ids, sets, size = [], [], 0


def _packed(ranges: int, few: int):
    """Shingles with their documents and components, packed by ranges of shingles.

    Of a shingle that more than ``few`` of some documents have, so many and one
    are sent: that says it isn't rare, however many have it.
    """

    def rows(wait: list) -> pa.RecordBatch:
        x, doc, comp = (np.concatenate(c) for c in zip(*wait, strict=True))
        order = np.argsort(x, kind="stable")
        x, doc, comp = x[order], doc[order], comp[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x) <= few
        x, doc, comp = x[keep], doc[keep], comp[keep]
        of = ((x >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)  # in order, as the shingles are
        found, start = np.unique(of, return_index=True)
        ends = [*start[1:].tolist(), len(x)]
        cut = [[c[i:j].tobytes() for i, j in zip(start.tolist(), ends, strict=True)] for c in (x, doc, comp)]
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(c, pa.binary()) for c in cut)], names=["range", "shingles", "docs", "comps"])

    def run(batches: Batches) -> Batches:
        wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc_id, comp, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(held.as_py(), np.uint64)
                wait.append((s, np.full(len(s), doc_id, np.int64), np.full(len(s), comp, np.int64)))
                size += len(s)
                if size > 1_000_000:
                    yield rows(wait)
                    size, wait = 0, []
        if size:
            yield rows(wait)

    return run


def _shared(most: int):
    """Of one range: how many rare shingles, those of ``most`` documents, a document has (``b`` null), and how many two documents of different components share."""

    def run(table: pa.Table) -> pa.Table:
        x, doc, comp = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("shingles", np.uint64), ("docs", np.int64), ("comps", np.int64)))
        order = np.argsort(x, kind="stable")
        doc, comp = doc[order], comp[order]
        _, start, n = np.unique(x[order], return_index=True, return_counts=True)
        left, right = [doc[:0]], [doc[:0]]
        for k in range(2, most + 1):
            at = start[n == k]
            for i in range(k):
                for j in range(i + 1, k):
                    apart = at[comp[at + i] != comp[at + j]]
                    left.append(np.minimum(doc[apart + i], doc[apart + j]))
                    right.append(np.maximum(doc[apart + i], doc[apart + j]))
        own, few = np.unique(doc[np.repeat(n <= most, n)], return_counts=True)
        b, a = np.concatenate(left), np.concatenate(right)
        pairs, times = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True) if len(a) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
        second = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(pairs[:, 1])])
        return pa.table({"a": np.concatenate([own, pairs[:, 0]]), "b": second, "n": np.concatenate([few, times])})

    return run


def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Estimated similarity: equal signature bytes, less what chance makes equal."""
    if not len(left):
        return pd.Series([], dtype="float64")
    a = np.frombuffer(b"".join(left), np.uint8).reshape(-1, HASHES)
    b = np.frombuffer(b"".join(right), np.uint8).reshape(-1, HASHES)
    same = (a == b).mean(axis=1)
    return pd.Series((same - 1 / 256) / (1 - 1 / 256))


def _common(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.zeros(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
        x.sort()
        out[i] = np.count_nonzero(x[1:] == x[:-1])
    return pd.Series(out)


def _verified(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """For each pair (a, b): whether it links, and bounds of its distance."""
    agreement = F.pandas_udf(_agreement, "double")
    common = F.pandas_udf(_common, "long")
    side = lambda k: sigs.select(F.col("doc_id").alias(k), F.col("sig").alias(f"sig_{k}"))
    est = scratch.save(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", agreement("sig_a", "sig_b").alias("est")),
        "estimates",
    )
    close = est.where(F.col("est") >= threshold - SIGNATURE_SLACK)
    half = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}"))
    size = lambda k: (F.octet_length(f"set_{k}") / 8).cast("long")
    full = (
        close.join(half("a"), "a")
        .join(half("b"), "b")
        .select("a", "b", common("set_a", "set_b").alias("both"), (size("a") + size("b")).alias("total"))
        .withColumn("of", F.col("total") - F.col("both"))
    )
    percent = round(100 * threshold)
    exact = full.select(
        "a",
        "b",
        (100 * F.col("both") >= percent * F.col("of")).alias("link"),
        (1 - F.col("both") / F.col("of")).alias("least"),
        (1 - F.col("both") / F.col("of")).alias("most"),
    )
    far = est.where(F.col("est") < threshold - SIGNATURE_SLACK).select(
        "a",
        "b",
        F.lit(False).alias("link"),
        F.greatest(F.lit(0.0), 1 - F.col("est") - SIGNATURE_SLACK).alias("least"),
        F.lit(1.0).alias("most"),
    )
    out = scratch.save(exact.unionByName(far), "verified")
    scratch.drop(est)
    return out


def _numbered(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Representatives with their node ``doc_id``: the least id of their text, or a free number if another text has that id.

    A bucket's centre is its least node. Originals tend to have the least ids,
    and copies are nearer to them than to each other, so nodes keep that order.
    """
    twice = reps.groupBy("first_id").agg(F.count("*").alias("n"), F.min("seq").alias("keeps"))
    twice = scratch.save(twice.where("n > 1").drop("n"), "repeated")
    if twice.isEmpty():
        return reps.withColumn("doc_id", F.col("first_id"))
    low, high = reps.agg(F.min("first_id"), F.max("first_id")).first()
    room = 2**62 - 1  # more than there are places
    if high < room:
        free = F.col("seq") + F.lit(high + 1)
    elif low > -room:
        free = F.lit(low - 1) - F.col("seq")
    else:  # ids at both ends of their range
        return reps.withColumn("doc_id", F.col("seq"))
    both = reps.join(twice, "first_id", "left")
    own = F.col("keeps").isNull() | (F.col("keeps") == F.col("seq"))
    return scratch.save(both.withColumn("doc_id", F.when(own, F.col("first_id")).otherwise(free)).drop("keeps"), "numbered")


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Components of documents whose shingle sets have at least this similarity.

    Input: ``doc_id`` and ``text``; other columns are ignored. Output, a row for
    each input row: ``doc_id, n_shingles, component_id, kept``.

    Null or empty texts, and texts of white space only, have an empty set and
    link with nothing; very long texts count whole. Equal texts always link.
    The graph's nodes are texts, not ids: rows that repeat a ``doc_id`` with
    another text are grouped each by its own text, so two groups never meet in
    an id; rows that repeat it with the same text have the same result each. A
    null ``doc_id`` is in no group: its ``component_id`` is null and it is kept.
    Empty tables give empty results. Two more columns tell rows with one id
    apart: ``text_key`` is the md5 of the text (null: empty), and ``leads`` says
    whether it is the one text that a group keeps, the least by id and key.
    """
    spark = docs.sparkSession
    shipped(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    table = scratch.save(
        map_arrow(keyed, _signatures, "doc_id bigint, fp binary, n_shingles bigint, sig binary, bands array<bigint>, text_key string"),
        "signatures",
    )
    real = table.where("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_key", "n_shingles", "sig", "bands"))
    reps = real.groupBy("fp").agg(least.alias("rep")).select("fp", F.monotonically_increasing_id().alias("seq"), F.col("rep.doc_id").alias("first_id"), "rep.text_key", "rep.n_shingles", "rep.sig", "rep.bands")
    reps = _numbered(scratch.save(reps, "representatives"), scratch)
    sigs = reps.select("doc_id", "n_shingles", "sig", "bands")

    rows = sigs.select(F.col("doc_id").alias("a"), F.explode("bands").alias("bucket"))
    centres = rows.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    buckets = scratch.save(rows.join(centres, "bucket"), "buckets")
    # The sets of all that share a bucket are made once; texts are shuffled for them alone.
    met = buckets.where("a <> b").select("a", "b").distinct()
    ids = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = reps.join(ids, "doc_id").select(F.col("doc_id").alias("node"), F.col("first_id").alias("doc_id"), "text_key")
    texts = keyed.join(wanted.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("node", "text")
    sets = scratch.save(map_arrow(texts, _sets, "doc_id bigint, shingles binary"), "sets")
    star = _verified(met, sigs, sets, threshold, scratch)
    first = connected_components(star.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    # What a bucket's centre has not linked: only pairs of different components.
    comp = lambda k: first.select(F.col("u").alias(k), F.col("v").alias(f"comp_{k}"))
    mixed = (
        buckets.join(comp("a"), "a", "left")
        .join(comp("b"), "b", "left")
        .withColumn("comp_a", F.coalesce("comp_a", "a"))
        .withColumn("comp_b", F.coalesce("comp_b", "b"))
    )
    odd = mixed.where("comp_a <> comp_b").select("bucket").distinct()
    mixed = scratch.save(
        mixed.join(odd, "bucket", "left_semi")
        .where("a <> b")
        .join(star.select("a", "b", "least", "most"), ["a", "b"])
        .select("bucket", "a", "comp_a", (F.col("comp_a") != F.col("comp_b")).alias("foreign"), "least", "most"),
        "mixed",
    )
    # In crowded buckets most pairs can share only what many there have: rare shingles are compared on their own.
    crowded = mixed.groupBy("bucket").agg((F.count("*") * F.count_if("foreign")).alias("pairs")).where(F.col("pairs") > CROWDED)
    crowd = mixed.join(crowded, "bucket", "left_semi").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp_a").alias("comp"))
    held = sets.join(crowd, "doc_id").select("doc_id", "comp", "shingles")
    held = scratch.save(held, "crowd")
    total = held.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    packed = map_arrow(held, _packed(1 + total // (8 * RANGE), RARE), "range int, shingles binary, docs binary, comps binary")
    rare = scratch.save(packed.groupBy("range").applyInArrow(_shared(RARE), "a long, b long, n long"), "rare")
    own_rare = rare.where("b is null").groupBy(F.col("a").alias("doc_id")).agg(F.sum("n").alias("few"))
    bound = sigs.select("doc_id", "n_shingles", "bands").join(crowd.select("doc_id", F.lit(True).alias("crowded")), "doc_id", "left").join(own_rare, "doc_id", "left")
    bound = bound.select(
        F.col("doc_id").alias("a"),
        "n_shingles",
        F.coalesce("crowded", F.lit(False)).alias("crowded"),
        (F.col("n_shingles") - F.coalesce("few", F.lit(0))).alias("common"),
        F.when(F.col("crowded"), F.col("bands")).alias("bands"),
    )
    mixed = scratch.save(mixed.join(bound, "a"), "bounded")
    x, y = mixed.where("foreign").alias("x"), mixed.alias("y")
    needed = threshold / (1 + threshold) * (F.col("x.n_shingles") + F.col("y.n_shingles")) - 1e-6
    gap = 1 - threshold + 1e-9
    rest = (
        x.join(
            y,
            (F.col("x.bucket") == F.col("y.bucket"))
            & (F.col("x.comp_a") != F.col("y.comp_a"))
            & (~F.col("y.foreign") | (F.col("x.a") < F.col("y.a")))
            & (F.col("x.least") - F.col("y.most") <= gap)
            & (F.col("y.least") - F.col("x.most") <= gap)
            & (F.least("x.n_shingles", "y.n_shingles") >= needed)
            & (~F.col("x.crowded") | ~F.col("y.crowded") | (F.least("x.common", "y.common") >= needed))
            # Crowded pairs that share several buckets meet in the first of them.
            & (F.col("x.bands").isNull() | F.col("y.bands").isNull() | F.coalesce(F.try_element_at(F.array_intersect("x.bands", "y.bands"), F.lit(1)) == F.col("x.bucket"), F.lit(True))),
        )
        .select(F.greatest("x.a", "y.a").alias("a"), F.least("x.a", "y.a").alias("b"))
        .distinct()
    )
    shared = rare.where("b is not null").groupBy("a", "b").agg(F.sum("n").alias("rare"))
    limits = lambda k: bound.select(F.col("a").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n_shingles", "common")))
    shared = shared.join(limits("a"), "a").join(limits("b"), "b")
    needed = threshold / (1 + threshold) * (F.col("n_shingles_a") + F.col("n_shingles_b")) - 1e-6
    shared = shared.where(F.col("rare") + F.least("common_a", "common_b") >= needed)
    rest = rest.unionByName(shared.select("a", "b")).distinct()
    rest = scratch.save(rest, "rest")
    if rest.isEmpty():
        last = first
    else:
        more = _verified(rest, sigs, sets, threshold, scratch)
        links = more.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
        last = first if links.isEmpty() else connected_components(first.unionByName(links), scratch)
    scratch.drop(buckets, mixed, sets)

    labels = reps.select("fp", "doc_id", "first_id", "text_key").join(last, F.col("doc_id") == F.col("u"), "left")
    labels = labels.select("fp", F.struct("first_id", "text_key").alias("first"), F.coalesce("v", "doc_id").alias("root"))
    names = labels.groupBy("root").agg(F.min("first").alias("lead"))
    labels = labels.join(names, "root").select("fp", F.col("lead.first_id").alias("component"), F.col("lead.text_key").alias("lead_key"))
    whole = table.select("doc_id", "fp", "n_shingles", "text_key").join(labels, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    leads = (F.col("lead_key").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("lead_key")))).alias("leads")
    return whole.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", kept, "text_key", leads)


def without_copies(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents of which one of each group of near duplicates is left, the one with the least id.

    Rows with one ``doc_id`` and different texts are judged each by its own
    text; of rows that repeat id and text, and of texts under one id that are
    near duplicates of each other, one is left. Rows without an id stay.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    told = scratch.save(near_duplicates(docs, threshold).select("doc_id", "leads", "text_key"), "told")
    key = "text_key"
    while key in docs.columns:
        key += "_"
    told, both = told.withColumnRenamed("text_key", key), ["doc_id", key]
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    left = keyed.join(told.where("not leads").select(*both), both, "left_anti")
    again = told.where("leads and doc_id is not null").groupBy(*both).count().where("count > 1").select(*both)
    if not again.isEmpty():
        again = scratch.save(again, "again")
        left = left.join(again, both, "left_anti").unionByName(left.join(again, both, "left_semi").dropDuplicates(both))
    return left.select(*docs.columns)
