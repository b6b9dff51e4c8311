import math
import random
from collections import Counter

from siltstone.llm import decontam, units
from siltstone.llm.decontam import Index, find_leaks, question_and_answer, words_of


def make(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and"] * 40 + ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 9))) for _ in range(1500)]
    sentence = lambda k: " ".join(rnd.choice(vocab) for _ in range(k)).capitalize() + "."
    items = [(i, sentence(rnd.randint(8, 20)) + " " + sentence(rnd.randint(6, 15))) for i in range(n)]
    return rnd, sentence, items


def brute(rows, threshold, words, k1=1.2, b=0.75):
    """Best scores of every item over all passages, from the BM25 formula and the items' texts alone."""
    bags = {i: words_of(t) for i, t in rows}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(w for bag in bags.values() for w in set(bag))
    weights = {}
    for i, bag in bags.items():
        tf = Counter(bag)
        x = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(bag) / mean)) for w, c in tf.items()}
        weights[i] = {w: v / sum(x.values()) for w, v in x.items()}
    window = max(map(len, bags.values())) + 32
    best = {}
    for s in range(0, max(1, len(words) - window + 32), 32):
        have = set(words[s : s + window])
        for i, x in weights.items():
            score = sum(v for w, v in x.items() if w in have)
            if score >= threshold:
                best[i] = max(best.get(i, 0), score)
    return best


def test_retrieval_equals_full_scoring():
    rnd, sentence, items = make()
    ix = Index.build(items)
    texts = []
    for k in range(25):
        parts = [sentence(12) for _ in range(40)] + [" ".join(rnd.sample(items[rnd.randrange(60)][1].split(), 9))]
        if k % 2:
            parts.insert(rnd.randrange(30), items[rnd.randrange(60)][1])
        if k % 5 == 0:
            parts.insert(3, "Çà “où” – Ünï ×ß Ω日本 ﬁ²")
        texts.append(" ".join(parts))
    texts += ["", " ", "the", items[3][1].upper()]
    got = ix.search_many([t.encode() for t in texts], 0.3, 0.0)
    for text, found in zip(texts, got, strict=True):
        assert {i: round(s, 6) for i, s, *_ in found} == {i: round(s, 6) for i, s in brute(items, 0.3, words_of(text)).items()}
    assert sum(map(len, got)) > 15


def test_chunks_and_blocks_do_not_matter(monkeypatch):
    rnd, sentence, items = make(3)
    texts = [" ".join([sentence(12) for _ in range(rnd.randint(0, 60))] + [items[rnd.randrange(60)][1]] * (k % 2)).encode() for k in range(30)]
    want = Index.build(items).search_many(texts)
    monkeypatch.setattr(decontam, "CELLS", 64)
    monkeypatch.setattr(decontam, "ITEMS_IN_BLOCK", 3)
    whole = units.chunks
    monkeypatch.setattr(units, "chunks", lambda t: whole(t, 300))
    assert Index.build(items).search_many(texts) == want and sum(map(len, want)) >= 15


def test_a_long_item_does_not_widen_passages():
    rnd, sentence, items = make(4)
    long = " ".join(sentence(12) for _ in range(120)) + " Which one is it then? " + sentence(9)
    ix = Index.build([*items, (500, long)])
    assert ix.window < 300
    clean = " ".join(sentence(12) for _ in range(90))
    got = ix.search_many([(clean + " " + long + " " + clean).encode(), clean.encode(), (clean + items[8][1]).encode(), long[: len(long) // 3].encode()])
    assert [[i for i, *_ in x] for x in got] == [[500], [], [8], []]


def test_leaks(spark):
    rnd, sentence, items = make(2)
    items += [(100, None), (101, ""), (None, "some text here")]
    clean = " ".join(sentence(12) for _ in range(60))
    junk = " ".join(w.upper() + "***" for w in items[7][1].split())
    rows = [(1, clean, "x"), (2, clean[:900] + "\n" + items[3][1] + " " + clean[900:], "x"), (3, junk, None), (4, None, None), (5, "", None),
            (6, items[5][1].split(". ")[0], None), (7, clean * 30 + items[9][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaked string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (20_000, 25):
        got = {r.doc_id: (r.leaked, r.item_id) for r in find_leaks(df, bench, part).collect()}
        assert got == {1: (False, None), 2: (True, 3), 3: (True, 7), 4: (False, None), 5: (False, None), 6: (False, None), 7: (True, 9)}
    assert find_leaks(df.limit(0), bench).collect() == []
    assert not any(r.leaked for r in find_leaks(df, bench.limit(0)).collect())


def test_question_and_answer():
    assert question_and_answer("What is the name of it? It is called the blue one.") == (words_of("what is the name of it"), words_of("it is called the blue one"))
    q, a = question_and_answer("one two three four five six")
    assert q == ["one", "two", "three", "four"] and a == ["five", "six"]
