import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import token_counts as C
from siltstone.llm import units

SCHEMA = "doc_id long, text string, n_tokens string"
#: What decides where pre-tokens begin.
PIECES = ["'s", "'ll", "'re", "'", "''", "s", "S", "re", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x85", "\x1c", "\0", "a", "Z", "über", "naïve", "中文", "и", "9", "٣", "²", "!", "...", "<|endoftext|>", "<|end", "|>", "-", "\U0001f600", "​", "᠎", "é", "ำ", "word", "antidisestablishmentarianism" * 2]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(C.default_tokenizer())


@pytest.fixture(scope="module")
def counter():
    return C.Counter(C.default_tokenizer())


def brute(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=30).map("".join))
def test_any_text(library, counter, text):
    assert counter.counts([text.encode(), b"", text.encode()]).tolist() == [brute(library, text), 0, brute(library, text)]


def test_classes_are_the_librarys(library):
    """Every character that isn't left to the library is cut as the library cuts it."""
    known = np.flatnonzero(C.classes() != C._UNKNOWN)
    assert len(known) > 90_000
    split = library.pre_tokenizer.pre_tokenize_str
    for i in range(0, len(known), 2000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n" for c in known[i : i + 2000].tolist())
        raw = text.encode() + b"\n"
        start, size, odd = C.pre_tokens(raw, np.array([len(raw) - 1]))
        want = [len(x[0]) for x in split(text)]  # byte letters, one for each byte
        assert not odd[0] and size.tolist() == want


def test_long_texts_are_cut_where_no_pre_token_crosses(library, monkeypatch):
    monkeypatch.setattr(units, "CHUNK", 50)
    rnd = random.Random(5)
    counter = C.Counter(C.default_tokenizer())
    texts = ["".join(rnd.choice(PIECES) for _ in range(400)), " ".join("it's 9 o'clock" for _ in range(200)), "x" * 5000, "\n\n".join("ab" for _ in range(500))]
    assert counter.counts([t.encode() for t in texts]).tolist() == [brute(library, t) for t in texts]


def test_summaries_keep_what_is_frequent():
    rnd = random.Random(1)
    parts, total = [], {}
    for _ in range(20):
        keys = [min(int(rnd.expovariate(0.02)), 3000) for _ in range(2000)]
        for k in keys:
            total[k] = total.get(k, 0) + 1
        x = np.array(keys, np.uint64)
        parts.append(C.Summary.empty().merged(C.Summary(x, x * 0, np.ones(len(x), np.int64)), most=100))
    out = parts[0]
    for p in parts[1:]:
        out = out.merged(p, most=100)
    got = dict(zip(out.first.tolist(), out.n.tolist()))
    n = sum(total.values())
    assert len(got) <= 100
    assert all(total[k] - n / 100 <= got.get(k, 0) <= total[k] for k in total)
    assert all(k in got for k, c in total.items() if c > n / 100)


def test_the_operator(spark, library, monkeypatch):
    """Nulls, empty and long texts, repeated rows, clashing columns; neither the table nor the cache changes a count."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))), "x") for i in range(60)]
    rows += [(1, rows[1][1], "x"), (None, "no id", None), (100, None, None), (101, "", None), (102, " ", None), (103, "word " * 60_000, None), (104, "a b" * 256, None), (105, "7" * 3000, None)]
    want = sorted(((i, len((t or "").encode()), brute(library, t), brute(library, t) > 512) for i, t, _ in rows), key=repr)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for most in (C.FREQUENT, 8):
        monkeypatch.setattr(C, "FREQUENT", most)
        got = C.token_counts(df)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert C.token_counts(df.limit(0)).collect() == []
    assert C.token_counts(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()[0].n_tokens == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["It's a test.", None, "", "über <|endoftext|> x"]
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(p.encode(x or "")) for x in texts]
    got = C.token_counts(spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], SCHEMA), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want


def test_the_query_is_the_library_over_all_documents(spark, library):
    import pyarrow.parquet as pq

    from siltstone.llm.entries import QUERIES

    root = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{root}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(tuple(r) for r in QUERIES["op11_token_counts"](spark, root).collect())
    assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), n := brute(library, r["text"]), n > 512) for r in rows)
