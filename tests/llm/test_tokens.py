import io
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import tokens, units
from siltstone.llm.packing import best_cuts, pack_documents
from siltstone.llm.tokens import Encoder, PackedReader, PackedWriter, default_tokenizer, pack, token_output, unpack, width

TEXTS = [
    "Don't you'll it's  NAÏVE café é İstanbul", "a\x1cb \xa0x y\x85z", "<|endoftext|> hi<|startoftext|>", "x²½ 12,345.67 #tag__a_b",
    "日本語 テスト🙂🙂", "'s 's 't", "", None, "\n\t ", "word " * 3000, "x" * 9000, "One. Two! Three? " * 700,
]
ROWS = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None), (6, "again", None), (6, "again", None)]
SCHEMA = "doc_id long, text string, start string"


def whole(text):
    t = Tokenizer.from_file(default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_encoder_equals_encode(text):
    assert Encoder.of(default_tokenizer()).ids(text).tolist() == whole(text)


def test_chunks_of_long_texts():
    """Texts cut into many chunks give the ids of the whole text."""
    texts = [t for t in TEXTS if t] + [" ".join(t for t in TEXTS if t) * 3]
    want = [whole(t) for t in texts]
    enc = Encoder(default_tokenizer())
    for most in (40, 700, 1 << 20):
        cut = units.chunks
        try:
            units.chunks = lambda x, most=most: cut(x, most)
            assert [x.tolist() for x in enc.texts([t.encode() for t in texts])] == want
        finally:
            units.chunks = cut


def test_an_encoder_that_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 5)
    enc = Encoder(default_tokenizer())
    for t in TEXTS:
        assert enc.ids(t).tolist() == whole(t)


def test_key_table_with_crowded_places():
    rng = np.random.default_rng(3)
    for bits, n in ((8, 180), (12, 2000)):
        k1, k2 = rng.integers(1, 50, n, dtype=np.uint64), rng.integers(0, 50, n, dtype=np.uint64)
        at, same = units.distinct(k1, k2)
        assert (k1[at][same] == k1).all() and (k2[at][same] == k2).all() and len(at) == len({*zip(k1.tolist(), k2.tolist())})
        table = units.KeyTable(bits)
        half = len(at) // 2
        table.add(k1[at[:half]], k2[at[:half]], np.arange(half))
        table.add(k1[at[half:]], k2[at[half:]], np.arange(half, len(at)))
        assert (table.find(k1, k2) == same).all()
        assert (table.find(k1 + np.uint64(100), k2) == -1).all()


def test_widths_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 7, 8, 13, 16, 17, 31, 32):
        x = rng.integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
        assert (unpack(pack(x, bits), len(x), bits) == x).all()
    assert width(49408) == 16 and width(65536) == 16 and width(65537) == 17 and width(1) == 1


def test_file_random_access():
    rng = np.random.default_rng(2)
    docs = [(d, rng.integers(0, 2**17, n).astype(np.uint32)) for d, n in ((4, 0), (None, 5), (9, 20_000), (10, 1), (-3, 4096), (11, 300_000))]
    out = io.BytesIO()
    w = PackedWriter(out, 17)
    for d, x in docs:
        w.add(d, x)
    w.close()
    r = PackedReader(pa.BufferReader(out.getvalue()))
    flat = np.concatenate([x for _, x in docs])
    for a, b in ((0, 1), (4095, 4097), (5, 5), (20_000, 200_000), (len(flat) - 1, len(flat))):
        assert (r.ids(a, b) == flat[a:b]).all()
    assert [(d, x.tolist()) for d, _, x in r.documents(1000)] == [(d, x.tolist()) for d, x in docs]


def test_token_output(spark):
    got = token_output(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    want, at = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole(t), 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output(spark.createDataFrame([], SCHEMA)).collect() == []


def cost(points, penalty, cuts, window):
    pen, total, last = dict(zip(points, penalty)), 0, 0
    for c in cuts:
        n = c - last
        power = n & (n - 1) == 0 and n >= 512
        total += (24 if power and n < window else 0 if power else window - n) + pen[c] + 1
        last = c
    return total


def test_best_cuts_against_quadratic_search():
    rnd = random.Random(4)
    for _ in range(40):
        points, x = [], 0
        for _ in range(60):
            x += rnd.choice([1, 7, 30, 200, 512, 700])
            points.append(x)
        penalty = [rnd.choice([0, 8, 48]) for _ in points]
        at, best = [0, *points], [0] + [10**9] * len(points)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= 2048:
                    power = n & (n - 1) == 0 and n >= 512
                    best[j] = min(best[j], best[i] + (24 if power and n < 2048 else 0 if power else 2048 - n) + penalty[j - 1] + 1)
        assert cost(points, penalty, best_cuts(points, penalty), 2048) == best[-1]


def test_packing(spark):
    got = [r.asDict() for r in pack_documents(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()]
    texts = {}
    for d, t, _ in ROWS:
        texts.setdefault(d, []).append([*whole(t), 1])
    for d, all_ids in texts.items():
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: (r["sequence_id"], r["offset"]))
        ids = [i for x in all_ids for i in x]
        assert sum(r["length"] for r in mine) == len(ids)
        if len(all_ids) == 1:
            at = 0
            for r in mine:
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
                at += r["length"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
