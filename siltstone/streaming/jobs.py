"""Structured Streaming entry points; their state lives in the query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions.lineage import shipped
from siltstone.operators.sessions import WINDOW_SECONDS

#: Rows that a message to the state holds at most.
SENT = 10_000


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream; checkpointed offsets stand for the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, late: str = "1 day", id_: str = "id", at: str = "occurred_at") -> DataFrame:
    """Events once by id, as long as repeats are no later than the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int = WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """Gap sessions of each key, emitted once the watermark has passed them."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    s = timed.groupBy(key, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return s.select(key, "first_at", "last_at", "n")


def debounced(triggers: DataFrame, key: str, at: str, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """One run for each burst of triggers."""
    return sessions(triggers, key, at, seconds, late).select(key, F.col("last_at").alias("run_after"), "n")


class ConversationProcessor(StatefulProcessor):
    """Conversations of one chat, message by message in order of time.

    Messages wait in ``waiting`` until the watermark has passed their time, when
    a timer fires and all that it has passed are taken at once, in order, so
    their order of arrival doesn't matter; the next timer is that of the first
    that still waits. ``known`` maps message ids to conversations, an entry for
    each message; a batch writes the entries of its own messages alone, and
    reads those that its own messages and the highest number so far (``top``)
    don't settle. Only messages that are not late count: Spark drops later ones
    and reports how many. A message that comes again, with the same time, number
    and target, is one message; of several with one number the first by time is
    the reply target.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, message_id long, reply_to long")
        self.known = handle.getMapState("known", "message_id long", "conversation long")
        self.current = handle.getValueState("current", "conversation long, last_at long, top long")

    def _wait(self, rows: list[tuple]) -> None:
        for i in range(0, len(rows), SENT):
            self.waiting.appendList(rows[i : i + SENT])
        if rows:
            self.handle.registerTimer(-(-min(rows)[0] // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: set[tuple] = set()
        for frame in rows:
            new.update(zip(frame["at"].tolist(), frame["message_id"].tolist(), frame["reply_to"].tolist(), strict=True))
        self._wait(list(new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = {tuple(k) for k in self.waiting.get()}
        ready = sorted(k for k in held if k[0] <= until)
        if not ready:
            return
        self.waiting.clear()
        self._wait([k for k in held if k[0] > until])
        current, last, top = self.current.get() if self.current.exists() else (-1, None, None)
        highest, seen = top, {}

        def told(message: int) -> int | None:
            if message not in seen and highest is not None and message <= highest:
                kept = self.known.getValue((message,))
                if kept is not None:
                    seen[message] = kept[0]
            return seen.get(message)

        out = []
        for at, message, reply in ready:
            target = told(reply) if reply else None
            if target is not None:
                conversation = target
            elif current >= 0 and (reply or at - last <= WINDOW_SECONDS * 1_000_000):
                conversation = current
            else:
                current += 1
                conversation = current
            last = at
            if told(message) is None:
                seen[message] = conversation
                self.known.updateValue((message,), (conversation,))
            top = message if top is None else max(top, message)
            out.append((key[0], message, conversation))
        self.current.update((current, last, top))
        yield pd.DataFrame(out, columns=["chat_id", "message_id", "conversation"])


def streaming_conversations(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """``chat_id, message_id, conversation`` of messages (``chat_id, message_id, date, reply_to``), once the watermark has passed them.

    The same conversations as ``sessions.conversations`` gives, in whatever
    order messages come, as long as none comes later than ``late``.
    """
    spark = messages.sparkSession
    shipped(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    m = messages.select("chat_id", "message_id", F.col("date").cast("timestamp").alias("date"), F.coalesce("reply_to", F.lit(0)).cast("long").alias("reply_to"))
    m = m.withColumn("at", F.unix_micros("date")).withWatermark("date", late)
    return m.groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=ConversationProcessor(), outputStructType="chat_id long, message_id long, conversation long", outputMode="Append", timeMode="EventTime"
    )


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a handler on each micro-batch: at a processing interval, or once over all that is there.

    The handler inserts by deduplication key, so a batch that is repeated after
    a failure adds nothing.
    """
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
