"""Grouping of chat messages into conversations.

A message that replies to an earlier one joins that one's conversation; one
whose target is unknown stays in the current conversation whatever the gap;
others open a new conversation after a gap. Reply chains are resolved by
pointer jumping: each round halves the remaining depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.lineage import checkpointed
from siltstone.functions.scoring import stable_id

WINDOW_SECONDS = 45 * 60
#: The length of a block of time, a day.
BLOCK_MICROS = 24 * 3600 * 1_000_000


def chained(rows: DataFrame, key: str, ts: str, order: str, seconds: int, free: Column, unknown_opens: bool) -> DataFrame:
    """Rows with ``_at``, their place in their key from 1, and ``_cur``, the number of their session from 0.

    A key's first row opens a session, and so does a row that is ``free`` to
    after more than the gap; ``unknown_opens`` says whether one without a known
    gap does. No key is sorted in one task: rows are numbered within blocks of
    time, and the blocks' totals, a row for each, are summed up over the key.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # Without nulls, so that the totals join by plain equality where the rows lie; unknown times come first.
    m = rows.withColumn("_us", at).withColumn("_free", F.coalesce(free, F.lit(False)))
    m = m.withColumn("_block", F.coalesce(F.floor(F.col("_us") / BLOCK_MICROS), F.lit(-(2**62)))).withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("\0")))
    w = Window.partitionBy("_key", "_block").orderBy("_us", order)
    opens = lambda gap, is_free: (is_free & F.coalesce(gap > seconds * 1_000_000, F.lit(unknown_opens))).cast("int")
    m = m.withColumn("_n", F.row_number().over(w))
    m = m.withColumn("_opens", F.when(F.col("_n") == 1, 0).otherwise(opens(F.col("_us") - F.lag("_us").over(w), F.col("_free")))).withColumn("_inner", F.sum("_opens").over(w))
    blocks = m.groupBy("_key", "_block").agg(F.count("*").alias("_rows"), F.sum("_opens").alias("_sum"), F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max(F.when(F.col("_n") == 1, F.col("_free"))).alias("_first_free"))
    k = Window.partitionBy("_key").orderBy("_block")
    blocks = blocks.withColumn("_number", F.row_number().over(k))
    opened = F.when(F.col("_number") == 1, 1).otherwise(opens(F.col("_first") - F.lag("_last").over(k), F.col("_first_free")))
    blocks = blocks.withColumn("_opened", opened)
    before = blocks.select(
        "_key", "_block", (F.sum("_rows").over(k) - F.col("_rows")).alias("_past"),
        (F.sum(F.col("_opened") + F.col("_sum")).over(k) - F.col("_sum") - 1).alias("_base"),
    )
    both = m.join(before, ["_key", "_block"])
    return both.select(*rows.columns, (F.col("_past") + F.col("_n")).alias("_at"), (F.col("_base") + F.col("_inner")).cast("long").alias("_cur"))


def gap_sessions(rows: DataFrame, key: str, ts: str, order: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Number the sessions of each key from 0 as ``session``: a new one after more than the gap."""
    return chained(rows, key, ts, order, seconds, F.lit(True), True).withColumnRenamed("_cur", "session").drop("_at")


def conversations(messages: DataFrame, seconds: int = WINDOW_SECONDS, max_rounds: int = 64) -> DataFrame:
    """Messages with ``conversation``, numbered from 0 by each chat's opening order.

    Messages: ``chat_id, message_id, date, reply_to`` (null or 0: none) and
    more. Of repeated message ids the first by date is the reply target.
    """
    m = messages.withColumn("_reply", F.nullif(F.col("reply_to"), F.lit(0)))
    m = chained(m, "chat_id", "date", "message_id", seconds, F.col("_reply").isNull(), False)
    targets = m.groupBy("chat_id", F.col("message_id").alias("_reply")).agg(F.min("_at").alias("_target"))
    m = m.join(targets, ["chat_id", "_reply"], "left")
    m = m.withColumn("_up", F.when((F.col("_at") > 1) & (F.col("_target") < F.col("_at")), F.col("_target"))).drop("_target", "_reply")

    # Only repliers jump; who doesn't reply has its own conversation.
    links = m.where("_up is not null").select("chat_id", F.col("_at").alias("_from"), F.col("_up").alias("_to"))
    base = links
    for _ in range(max_rounds):
        ahead = base.select("chat_id", F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        nxt = base.join(ahead, ["chat_id", "_to"], "left").select("chat_id", "_from", F.coalesce("_far", "_to").alias("_to"), F.col("_far").isNotNull().alias("_moved"))
        nxt = checkpointed(nxt)
        base = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            break
    else:
        raise RuntimeError(f"reply chains are longer than 2**{max_rounds}")
    roots = m.select("chat_id", F.col("_at").alias("_to"), F.col("_cur").alias("_root"))
    through = base.join(roots, ["chat_id", "_to"]).select("chat_id", F.col("_from").alias("_at"), "_root")
    out = m.join(through, ["chat_id", "_at"], "left").withColumn("conversation", F.coalesce("_root", "_cur").cast("long"))
    return out.select(*messages.columns, "conversation")


def line_of(sender, text):
    """``sender: text``; a message without a sender is a ``user``'s."""
    return F.concat(F.coalesce(F.nullif(T.trimmed(sender), F.lit("")), F.lit("user")), F.lit(": "), T.trimmed(text))


def transcripts(rows: DataFrame, key: str, order: str, sender: str, text: str) -> DataFrame:
    """The lines of each conversation in order, as ``transcript``; a conversation must fit a row."""
    said = F.array_sort(F.collect_list(F.struct(order, line_of(sender, text).alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("transcript"))


def grouped(messages: DataFrame, min_messages: int = 1, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Conversations ``chat_id, first_message_id, last_message_id, n, raw_text, created_at, updated_at, message_ids`` of at least ``min_messages``."""
    c = conversations(messages, seconds).withColumn("_line", line_of("sender_name", "text"))
    said = F.array_sort(F.collect_list(F.struct("date", "message_id", F.col("_line").alias("line"))))
    g = c.groupBy("chat_id", "conversation").agg(
        F.min("message_id").alias("first_message_id"), F.max("message_id").alias("last_message_id"), F.count("*").alias("n"), said.alias("m")
    )
    return g.where(F.col("n") >= min_messages).select(
        "chat_id", "first_message_id", "last_message_id", "n",
        F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("raw_text"),
        F.element_at("m", 1)["date"].alias("created_at"), F.element_at("m", -1)["date"].alias("updated_at"),
        F.transform("m", lambda x: x["message_id"]).alias("message_ids"),
    )


def conversation_documents(groups: DataFrame) -> DataFrame:
    """Conversations as documents of low authority."""
    return groups.select(
        stable_id(F.lit("telegram"), "chat_id", "first_message_id").alias("id"),
        F.lit("telegram").alias("source"),
        F.concat_ws(":", F.col("chat_id").cast("string"), F.col("first_message_id").cast("string")).alias("source_id"),
        F.lit(None).cast("string").alias("url"),
        F.format_string("Telegram support request (chat %d)", "chat_id").alias("title"),
        F.col("raw_text").alias("body"),
        T.body_hash("raw_text").alias("body_hash"),
        F.create_map(
            F.lit("source"), F.lit("telegram"), F.lit("chat_id"), F.col("chat_id").cast("string"),
            F.lit("message_ids"), F.to_json("message_ids"), F.lit("status"), F.lit("new"), F.lit("authority"), F.lit("low"),
        ).alias("metadata"),
        "created_at", "updated_at",
    )


def cursors(messages: DataFrame) -> DataFrame:
    """The newest message id of each chat."""
    return messages.groupBy("chat_id").agg(F.max("message_id").alias("message_id"))


def encoded_cursor(newest: DataFrame) -> DataFrame:
    """One row: the cursors of all chats as a JSON object ``{"per_chat": {chat: message}}``; empty without chats."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("chat_id").cast("string").alias("key"), F.col("message_id").alias("value"))))
    return newest.agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("per_chat"))).alias("cursor"))


def decoded_cursor(states: DataFrame, cursor: str = "cursor") -> DataFrame:
    """``chat_id, message_id`` of stored cursors; one that can't be read, or is empty, is no cursor."""
    seen = F.from_json(cursor, "per_chat map<string,bigint>")["per_chat"]
    rows = states.select(F.explode(seen).alias("chat_id", "message_id"))
    return rows.select(F.expr("try_cast(chat_id as bigint)").alias("chat_id"), "message_id").where("chat_id is not null")


def after_cursor(messages: DataFrame, newest: DataFrame) -> DataFrame:
    """Messages that a cursor table hasn't seen."""
    seen = newest.select("chat_id", F.col("message_id").alias("_seen"))
    return messages.join(seen, "chat_id", "left").where("_seen is null or message_id > _seen").drop("_seen")
