"""Chat formatting over reply trees.

Messages form trees by their parents. Self-joins that double their reach find
each message's root, depth and path score in log2(depth) rounds; the same
links, read backwards, list the messages of the chosen root-to-leaf paths. Only
ids and scores move in these joins, so a long chain costs rows times rounds.
The best-ranked branches of each conversation are formatted, each as one text
with the spans that carry loss.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts every control string, of this and other common templates, gets a
backslash after its first character; those that have backslashes there already
get one more, so unescaping restores every text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, Scratch, map_arrow

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Fixed: the rest of a control string after its first character, < or [.
_REST = r"(\||/?s>|</?SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _REST)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)
#: Rounds of doubling; 2**40 messages in one path. What is longer is a cycle.
MAX_ROUNDS = 40
_NO_ID = -(2**63)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """One text, and (start, length) of each span under the loss mask, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(_role_in(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def chain_of_turns(rows: DataFrame) -> DataFrame:
    """Messages of a table ``conv_id, turn, role, text``: each turn replies to the one before it.

    Rows of equal turn follow each other by role, then text. Null texts and
    roles count as empty; null turns come first.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(by).cast("long").alias("msg_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv_id",
        "msg_id",
        F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def best_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """Messages of the best branches: ``conv_id, branch, place, msg_id``; place counts back from the leaf.

    ``messages``: ``conv_id, msg_id`` (unique together, not null), ``parent_id``
    and ``score`` (null: 0). A parent that isn't there makes a root. Messages on
    a cycle of parents are on no path. Branches rank by mean score, then
    length, then the least leaf id.
    """
    m = messages.select("conv_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = m.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    node = m.join(there, ["conv_id", "parent_id"], "left")
    node = node.select("conv_id", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    jumps = [scratch.save(node, "reach-1")]
    while True:
        now = jumps[-1]
        if len(jumps) > MAX_ROUNDS or now.where("up is not null").isEmpty():
            break
        above = now.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        far = now.where("up is not null").join(above, ["conv_id", "up"])
        far = far.select("conv_id", "msg_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        jumps.append(scratch.save(now.where("up is null").unionByName(far), f"reach-{2 ** len(jumps)}"))
    parents = jumps[0].where("up is not null").select("conv_id", F.col("up").alias("msg_id")).distinct()
    leaves = jumps[-1].where("up is null").join(parents, ["conv_id", "msg_id"], "left_anti")
    rank = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "msg_id")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = chosen.select("conv_id", "branch", F.lit(0).cast("long").alias("place"), "msg_id")
    for k in range(len(jumps) - 2, -1, -1):
        step = jumps[k].where("up is not null").select("conv_id", "msg_id", "up")
        more = path.join(step, ["conv_id", "msg_id"]).select("conv_id", "branch", (F.col("place") + 2**k).alias("place"), F.col("up").alias("msg_id"))
        path = path.unionByName(more)
        if k % 4 == 0:
            path = scratch.save(path, "path")
    return path


def _format(batches: Batches) -> Batches:
    for batch in batches:
        texts, starts, lengths = [], [], []
        for turns in batch.column(2):
            t, spans = format_turns([(x["role"].as_py(), x["text"].as_py()) for x in turns])
            texts.append(t)
            starts.append([s for s, _ in spans])
            lengths.append([n for _, n in spans])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(starts, kind), pa.array(lengths, kind)],
            names=["conv_id", "branch", "formatted", "loss_start", "loss_length"],
        )


def format_conversations(messages: DataFrame, branches: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """A row for each chosen branch: ``conv_id, branch, formatted, loss_start, loss_length`` (arrays of the masked spans, in code points)."""
    scratch = scratch or Scratch(messages.sparkSession, "chat")
    messages = scratch.save(messages.withColumn("conv_id", F.coalesce("conv_id", F.lit(_NO_ID))), "messages")
    path = best_paths(messages, scratch, branches)
    turns = path.join(messages.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"])
    whole = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), "role", "text"))).alias("turns"))
    whole = whole.select(F.when(F.col("conv_id") != _NO_ID, F.col("conv_id")).alias("conv_id"), "branch", "turns")
    return map_arrow(whole, _format, "conv_id long, branch int, formatted string, loss_start array<long>, loss_length array<long>")


def _digest(batches: Batches) -> Batches:
    for batch in batches:
        rows = []
        for conv, text, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse_turns(text)
            loss = "".join(unescape(text[s : s + n]) for s, n in zip(starts, lengths, strict=True))
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def chat_digests(rows: DataFrame) -> DataFrame:
    """Format all conversations, write them, and describe each as read back from the output.

    Input: ``conv_id, turn, role, text``. Output: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``. Rows without a
    ``conv_id`` are one conversation with a null id. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "chat")
    written = scratch.save(format_conversations(chain_of_turns(rows), scratch=scratch), "formatted")
    return map_arrow(
        written.select("conv_id", "formatted", "loss_start", "loss_length"),
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
