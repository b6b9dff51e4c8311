"""The pipeline against a plain version of every stage on collected rows."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import decontam, langid, quality
from siltstone.llm.tokens import default_tokenizer

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_of_groups(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}


def test_pipeline(spark, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    models = langid.train(docs, langid.learnable())
    left = {i: r for i, r in rows.items() if not models.predict(r.text)[3]}
    assert len(left) == len(rows)  # all have a known language
    model = quality.train(docs, labels, quality.remainder("doc_id", 3) != 1)
    left = {i: r for i, r in left.items() if model.score(*quality.features(r.text, r.n_chars)) >= corpus_pipeline.QUALITY_FLOOR}
    kept = least_of_groups({i: r.text for i, r in left.items()})
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    holds = lambda text: any(f" {' '.join(w)} " in f" {' '.join(decontam.words_of(text))} " for w in items)
    want = {i for i in kept if not holds(rows[i].text)}

    got = [r.asDict() for r in corpus_pipeline.run(spark, ROOT).collect()]
    assert {r["doc_id"] for r in got} == want and len(want) > 50
    t = Tokenizer.from_file(default_tokenizer())
    for i in want:
        ids, at = [*t.encode(rows[i].text, add_special_tokens=False).ids, 1], 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_rejected_documents_go(spark):
    """Texts in a script or with letters that no learnt language explains go; all of known languages stay."""
    base = spark.read.parquet(f"{ROOT}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (9003, "русский текст о разных вещах " * 20, None, "s", 1), (9004, "日本語の文章です。" * 30, None, "s", 1), (9005, "", None, None, None), (9006, "qxzj vvkq xqjz wqxk zzxq " * 30, None, "s", 1)],
        base.schema,
    )
    out = corpus_pipeline.language(spark, base.unionByName(odd), ROOT)
    assert out.columns == base.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in base.collect()}


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id with several texts, and a column with the name of a result."""
    base = spark.read.parquet(f"{ROOT}/documents.parquet")
    good = base.where("length(text) between 400 and 2000").orderBy("doc_id").first()
    other = base.where("length(text) between 400 and 2000").orderBy(base.doc_id.desc()).first()
    rows = [
        (None, None, None, None, None), (8001, None, None, None, None), (8002, "", "en", "s", 0), (8003, good.text, good.lang, None, None),
        (8003, good.text, good.lang, None, None), (8004, other.text, None, "s", 3), (8004, good.text, None, "s", 3), (None, good.text, good.lang, "s", 1),
        (8005, " ".join([other.text] * 400), other.lang, "s", None),
    ]
    return base.limit(120).unionByName(spark.createDataFrame(rows, base.schema)), good.text, other.text


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    docs, good, other = odd_rows(spark)
    for c in ("score", "leaked", "rejected", "text_key"):
        docs = docs.withColumn(c, docs.n_chars * 0)
    got = [r.asDict() for r in corpus_pipeline.STAGES[stage][1](spark, docs, ROOT).collect()]
    name = corpus_pipeline.STAGES[stage][0]
    mine = sorted((r["doc_id"] or -1) for r in got if r["doc_id"] is None or r["doc_id"] > 8000)
    if name == "packing":
        assert {*mine} == {-1, 8001, 8002, 8003, 8004, 8005}
        assert [r["length"] for r in got if r["doc_id"] in (8001, 8002)] == [1, 1]
        return
    assert set(got[0]) == set(docs.columns) and all(r[c] in (0, None) for r in got for c in ("score", "leaked", "rejected", "text_key"))
    if name == "language":
        assert mine == [-1, 8003, 8003, 8004, 8004, 8005]
    elif name == "near_duplicates":  # copies of texts under lower ids go; the long text repeats one of them
        texts = [r["text"] for r in got if r["text"]]
        assert good in texts and other in texts
        assert [i for i in mine if i in (-1, 8001, 8002)] == [-1, -1, 8001, 8002]
        assert len({(r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in got)
    elif name == "decontamination":
        assert [i for i in mine if i in (-1, 8001, 8002)] == [-1, -1, 8001, 8002]


@pytest.mark.parametrize("stage", range(5))
def test_empty_input(spark, stage):
    empty = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, ROOT).collect() == []
