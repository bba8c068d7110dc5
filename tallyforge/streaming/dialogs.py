"""Dialog state as a stream: turns in, the state of their chats out, with timers for chats that end.

What a turn says is found by the expressions of ``operators.dialogs``; a keyed processor keeps what a
chat has said so far. Products are kept with the turn that named them first, sizes and confirmations
with the turn they come from, so turns may arrive in any order, and more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.dialogs import turn_facts

#: The store that keyed processors need (a setting of the session that runs the stream).
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATES = "chat_id bigint, last_id bigint, turns bigint, mentioned array<string>, rejected array<string>, confirmed string, size string, ended boolean"


def read_turns(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class ChatState(StatefulProcessor):
    """What one chat has said: a value state with its scalars, a list state of products by kind.

    idle: milliseconds of event time after the last turn when a chat ends. Its last state is then
    emitted once more with ``ended``, and forgotten; a later turn begins a new one. Ids of turns are
    kept as long as the watermark lets them come again.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", "last_id bigint, last_ms bigint, confirmed string, confirmed_id bigint, size string, size_id bigint, turns bigint, mark bigint")
        self.products = handle.getListState("products", "kind string, product string")
        self.seen = handle.getListState("seen", "id bigint, ms bigint")

    def _now(self, key, ended: bool) -> Row:
        last_id, _, confirmed, _, size, _, turns, _ = self.scalars.get()
        found = sorted({(k, p) for k, p in self.products.get()})
        of = lambda kind: [p for k, p in found if k == kind]
        return Row(chat_id=key[0], last_id=last_id, turns=turns, mentioned=of("mentioned"), rejected=of("rejected"), confirmed=confirmed, size=size, ended=ended)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = dict(self.seen.get()) if self.seen.exists() else {}
        first = (-1, 0, None, -1, None, -1, 0, 0)
        last_id, last_ms, confirmed, confirmed_id, size, size_id, turns, mark = self.scalars.get() if self.scalars.exists() else first
        have = {(k, p) for k, p in self.products.get()} if self.products.exists() else set()
        fresh: set[tuple[str, str]] = set()
        before = turns
        for r in rows:
            if r.id in known:
                continue
            known[r.id] = r.ms
            turns += 1
            last_id, last_ms = max(last_id, r.id), max(last_ms, r.ms)
            fresh |= {("mentioned", p) for p in r.named} | {("rejected", p) for p in r.refused}
            if r.confirmed is not None and r.id > confirmed_id:
                confirmed, confirmed_id = r.confirmed, r.id
            if r.size is not None and r.id > size_id:
                size, size_id = r.size, r.id
        if turns == before:
            return
        # turns behind an earlier watermark don't come again: the stream drops them
        self.seen.put(sorted((i, ms) for i, ms in known.items() if ms >= mark))
        if fresh - have:
            self.products.appendList(sorted(fresh - have))
        self.scalars.update((last_id, last_ms, confirmed, confirmed_id, size, size_id, turns, max(mark, timerValues.getCurrentWatermarkInMs())))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last_ms + self.idle)
        yield self._now(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.scalars.exists():
            yield self._now(key, True)
        for state in (self.scalars, self.products, self.seen):
            state.clear()

    def close(self) -> None:
        pass


def dialog_states(turns: DataFrame, products: dict[str, str], negation: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(chat_id, last_id, turns, mentioned, rejected, confirmed, size, ended): the state of a chat after each
    batch that has new turns of it (chat_id, id, role, content, ts), and once more when it ends.

    turns: the number of turns seen. Turns that arrive up to ``late`` behind the newest one count, in any
    order; a turn that arrives again changes nothing. A chat ends ``idle`` after its last turn, in event
    time. Turns without chat, id or time are left out. Needs the state store ``STORE``.
    """
    seconds = turns.sparkSession.sql(f"select cast(interval {idle} as interval day to second) as i").first().i.total_seconds()
    rows = turns.filter("chat_id is not null and id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    facts = turn_facts(rows, products, negation).select(F.col("chat_id").cast("bigint").alias("chat_id"), F.col("id").cast("bigint").alias("id"), "ts", F.unix_millis("ts").alias("ms"), F.col("_n").alias("named"), F.col("_r").alias("refused"), F.col("_c").alias("confirmed"), F.col("_s").alias("size"))
    return facts.groupBy("chat_id").transformWithState(statefulProcessor=ChatState(int(seconds * 1000)), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
