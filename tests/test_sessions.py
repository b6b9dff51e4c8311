"""Sessions and conversations by blocks of time against a plain walk over each chat."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import sessions as G

T0 = datetime(2026, 5, 1, 22)
SCHEMA = "chat_id long, message_id long, date timestamp, reply_to long, _note string"


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    out, at = [], {}
    for i in range(1, n):
        chat = rnd.choice([1, 1, 1, 1, 2, 3, None])
        at[chat] = at.get(chat, T0) + timedelta(minutes=rnd.choice([0, 0, 1, 44, 45, 46, 600, 3000]))
        out.append((chat, i, at[chat], rnd.choice([None, None, 0, max(1, i - rnd.randint(1, 50)), 9999, i + 3]), "x"))
    return out


def walk(rows, seconds, replies):
    """(session, conversation) of each message, chat by chat in order of time."""
    out = {}
    for chat in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == chat), key=lambda r: (r[2], r[1]))
        cur, last, of = -1, None, {}
        for _, i, t, reply, _ in mine:
            reply = reply or None if replies else None
            opens = last is None or (reply is None and (t - last).total_seconds() > seconds)
            cur += opens
            of[i] = of[reply] if last is not None and reply in of else cur
            last = t
            out[(chat, i)] = of[i]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.chat_id, r.message_id): r.session for r in G.gap_sessions(df, "chat_id", "date", "message_id").collect()}
    assert got == walk(rows, G.WINDOW_SECONDS, False)
    kept = [r for r in rows if r[0] is not None]
    got = G.conversations(spark.createDataFrame(kept, SCHEMA).repartition(5))
    assert got.columns == [*df.columns, "conversation"]
    assert {(r.chat_id, r.message_id): r.conversation for r in got.collect()} == walk(kept, G.WINDOW_SECONDS, True)


def test_unknown_times_and_none(spark):
    rows = [(1, 1, None, None, ""), (1, 2, None, None, ""), (1, 3, T0, None, ""), (1, 4, T0 + timedelta(minutes=1), None, "")]
    got = G.gap_sessions(spark.createDataFrame(rows, SCHEMA), "chat_id", "date", "message_id").orderBy("message_id").collect()
    assert [r.session for r in got] == [0, 1, 2, 2]
    assert G.gap_sessions(spark.createDataFrame([], SCHEMA), "chat_id", "date", "message_id").collect() == []
    assert G.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_chat_spreads_over_tasks(spark):
    """A single chat over many days is numbered in many partitions; only a row a day meets in one."""
    n = spark.range(20_000).select(F.lit(1).alias("chat_id"), F.col("id").alias("message_id"), F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, id * 10)").alias("date"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = G.gap_sessions(n, "chat_id", "date", "message_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 10_000
    ordered = G.gap_sessions(n, "chat_id", "date", "message_id", 60).agg(F.count_distinct("session"), F.max("session")).first()
    assert tuple(ordered) == (20_000, 19_999)
