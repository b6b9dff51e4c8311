import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import langid, quality

DOCS = "/root/testdata/sf0.01/documents.parquet"
LABELS = "/root/testdata/sf0.01/labels.parquet"


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine.untrained()
    m.w, m.v, m.bias = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape) * 0.1, 0.3
    i, x = quality.features("Some words here, and some more words!", None)
    y = x.copy()
    y[-len(quality.STATS) :] = np.clip(y[-len(quality.STATS) :], -4, 4)
    z = m.bias + sum(m.w[a] * b for a, b in zip(i, y, strict=True))
    z += sum((m.v[i[a]] @ m.v[i[b]]) * y[a] * y[b] for a, b in itertools.combinations(range(len(i)), 2))
    assert abs(m.score(i, x) - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    score = {r.doc_id: r for r in got}
    test = [(r.quality, score[r.doc_id]) for r in labels.collect() if score[r.doc_id].held_out]
    assert np.mean([y == r.predicted for y, r in test]) > 0.95
    assert np.mean([r.predicted for y, r in test if y == 1]) > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "x"), (None, "w " * 60000, 5, None), (2, "", 0, "x")], "doc_id long, text string, n_chars long, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert quality.quality_scores(docs.limit(0), none).collect() == []
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert len(quality.quality_scores(docs, odd).collect()) == 4


def test_kneser_ney_sums_to_one():
    """In every seen context the probabilities of all symbols and of one unseen symbol add up to 1."""
    rnd = random.Random(2)
    x = langid.symbols(" ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(400)))
    g, n = np.unique(langid.grams(x, langid.ORDER), return_counts=True)
    m = langid.Models.build({"xx": (g, n)})
    known = np.unique(x)
    for ctx in np.unique(g >> np.uint64(16))[:50]:
        p = np.exp(m._lookup((ctx << np.uint64(16)) | known, langid.ORDER - 1)[:, 0]).sum()
        p += np.exp(m._lookup((ctx << np.uint64(16)) | np.array([0x7A7], np.uint64), langid.ORDER - 1)[0, 0])
        assert abs(p - 1) < 1e-9


def test_language_held_out(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: r for r in langid.language_ids(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert not any(r.rejected for r in got.values())


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, t, k, "x") for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 40)]
    rows += [(900, None, "en", None), (901, "", "de", None), (902, "123 !!", None, None), (None, "the dog", None, None), (903, "the cat", None, None)]
    got = {r.doc_id: r for r in langid.language_ids(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == "en" and got[None].lang_pred == "en" and 0.5 < got[903].score <= 1
    many = [(i, "the cat and the dog " * (1 + i % 3), "en", None) for i in range(500)]
    models = langid.train(spark.createDataFrame(many, schema), F.lit(True))
    assert models.predict("русский текст здесь")[3]
    empty = langid.language_ids(spark.createDataFrame([], schema))
    assert empty.collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, None)], schema)
    assert [r.lang_pred for r in langid.language_ids(unlabelled).collect()] == ["und"]


def test_every_gram_counts(spark):
    """More distinct 4-grams than a model once kept: each has its own probability."""
    import string

    words = ["".join(w) for w in itertools.islice(itertools.product("あいうえおかきくけこさしすせそたちつてと" + string.ascii_lowercase, repeat=4), 0, None, 19)]
    text = " ".join(words)
    rows = [(i, text[k : k + 20_000], "xx") for i, k in enumerate(range(0, len(text), 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    aside = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).collect()}
    want = np.unique(np.concatenate([langid.grams(langid.symbols(t), langid.ORDER) for i, t, _ in rows if i not in aside]))
    assert len(want) > 200_000
    models = langid.train(docs)
    assert len(models.tables[langid.ORDER - 1][0]) == len(want)


def test_texts_beyond_the_calibration_are_counted(spark, monkeypatch):
    """Few of the left-out texts calibrate; the words of the others are learnt."""
    monkeypatch.setattr(langid, "MAX_CALIBRATION", 3)
    ids = [r.id for r in spark.range(4000).where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).collect()]
    word = {i: "".join(chr(0x4E00 + 40 * k + j) for j in range(20)) for k, i in enumerate(ids)}
    docs = spark.createDataFrame([(i, word.get(i, "the cat and the dog"), "xx") for i in range(4000)], "doc_id long, text string, lang string")
    known = set(langid.train(docs).tables[langid.ORDER - 1][0].tolist())
    learnt = [i for i in ids if all(int(h) in known for h in langid.grams(langid.symbols(word[i]), langid.ORDER) * langid._SPREAD)]
    assert len(learnt) == len(ids) - 3


def test_limit_does_not_follow_the_worst_text():
    x = langid.grams(langid.symbols("the cat and the dog " * 20), langid.ORDER)
    m = langid.Models.build({"xx": np.unique(x, return_counts=True)})
    m.calibrate([("xx", "the cat and the dog")] * 400 + [("xx", "zzqqxx")])
    assert m.predict("zzqqxx")[3] and not m.predict("the dog and the cat")[3]
