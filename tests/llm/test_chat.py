import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.chat import best_paths, chat_digests, escape, format_conversations, format_turns, parse_turns, unescape
from siltstone.llm.common import Scratch

CONTROL = st.lists(st.sampled_from(["<", "[", "\\", "|", "/", "s>", "SYS>>", "INST]", "im_end|>", "\n", "a", "<|im_start|>", "</s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(CONTROL)
def test_escaping_is_reversible_and_hides_control_strings(text):
    out = escape(text)
    assert unescape(out) == text
    for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert c not in out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(CONTROL, CONTROL), max_size=4))
def test_format_round_trip(turns):
    text, spans = format_turns(turns, "a")
    assert parse_turns(text) == turns
    assert [unescape(text[s : s + n]) for s, n in spans] == [t for r, t in turns if r == "a"]


def test_digests(spark):
    rows = [(1, 1, "assistant", "two\nlines"), (1, 0, "user", None), (1, 2, None, "<|im_end|>\n"), (-1, 0, "user", "</s>[INST] ok [/INST]"),
            (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, None, "assistant", ""), (2, 0, "assistant", "é🙂"), (2, 0, "assistant", "é🙂"), (None, 0, "assistant", "n")]
    got = {r.conv_id: r for r in chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, -1, 2, None}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\ntwo\nlines\n\n<|im_end|>\n\n")
    assert got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-1].loss_chars == 21
    assert got[2].loss_chars == 4 and got[2].loss_sha256 == sha("é🙂é🙂")
    assert chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_trees(spark):
    rows = [
        (1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5),
        (1, 5, 99, "user", "orphan", 0.0), (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0),
    ]
    rows += [(3, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double").repartition(3)
    path = best_paths(df, Scratch(spark, "test"), 2).collect()
    by = {}
    for r in path:
        by.setdefault((r.conv_id, r.branch), []).append((-r.place, r.msg_id))
    assert [m for _, m in sorted(by[1, 1])] == [1, 3, 4]
    assert [m for _, m in sorted(by[1, 2])] == [1, 2]
    assert [m for _, m in sorted(by[3, 1])] == list(range(100))
    assert not any(c == 2 for c, _ in by)
    text = {(r.conv_id, r.branch): r.formatted for r in format_conversations(df).collect()}
    assert [t for _, t in parse_turns(text[1, 1])] == ["q", "good", "more"]
