"""Keyed state: folds over each key's events in the order of their times, and documents that are held until others arrive. Each has a batch form and a streaming one that share their steps.

The batch forms sort each partition and pass over its rows, so that of a key of any size only its state is held. The streaming forms keep state by
`transformWithState`; the session's store must be RocksDB (see configure()). Rows of a stream wait in list state until the watermark has passed them and are folded in
the order of their times then, so that rows that come late, but not later than the watermark allows, give what the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A document lives for so long after its last touch: it goes with the first insertion later than that.
TTL = timedelta(minutes=60)
#: Keys that a stream of documents is dealt to; every insertion is told to all of them.
SHARDS = 16


def configure(spark: SparkSession) -> None:
    """transformWithState needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def averaged(value: float | None, row: Row) -> float:
    """The first timing, rounded; then half the value and half the timing, rounded. A value of 0 is none."""
    ms = row["ms"]
    return float((0.5 * value + 0.5 * ms + 0.5) // 1) if value else float((ms + 0.5) // 1)


def stepped(value: list[str], row: Row) -> list[str]:
    """States of steps after an event. Starting a pending step completes an active earlier one and drops the earlier ones never started; a step that isn't pending doesn't start again. A failure fails what is active."""
    if row["failed"]:
        return ["failed" if s == "active" else s for s in value]
    k = row["step"]
    if not 0 <= k < len(value) or value[k] != "pending":
        return value
    before = [{"pending": "dropped", "active": "done"}.get(s, s) for s in value[:k]]
    return [*before, "active", *value[k + 1 :]]


def fold_batch(events: DataFrame, keys: list[str], columns: list[str], start, step: Callable, kind: str) -> DataFrame:
    """(keys, value): step folded over each key's rows by ts, then event_id. columns: what step reads."""
    fields = [f for f in events.schema if f.name in keys]
    schema = ", ".join(f"{c} {next(f for f in fields if f.name == c).dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, None
        kinds = None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0][k] for r in rows], t) for k, t in enumerate(kinds)] + [pa.array([r[1] for r in rows])], [*keys, "value"])

        for b in batches:
            kinds = [b.schema.field(c).type for c in keys]
            done = []
            own = [b.column(c).to_pylist() for c in keys]
            read = [b.column(c).to_pylist() for c in columns]
            for k in range(b.num_rows):
                key = tuple(c[k] for c in own)
                if key != now:
                    if now is not None:
                        done.append((now, value))
                    now, value = key, start
                value = step(value, {c: x[k] for c, x in zip(columns, read, strict=True)})
            yield from out(done)
        if now is not None:
            yield from out([(now, value)])

    ordered = events.select(*keys, "ts", "event_id", *columns).repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    return ordered.mapInArrow(run, f"{schema}, value {kind}")


class OrderedFold(StatefulProcessor):
    """Folds a key's rows (with their times in microseconds, at) once the watermark has passed them, by ts, then event_id; gives the value after each time that it grew."""

    def __init__(self, keys: list[str], columns: list[str], row_schema: str, start, step: Callable, kind: str):
        self.keys, self.columns, self.row_schema, self.start, self.step, self.kind = keys, columns, row_schema, start, step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, event_id long, {self.row_schema}")
        self.value = handle.getValueState("value", f"value {self.kind}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["event_id"], *(r[c] for c in self.columns)) for r in rows]
        self.waiting.appendList(new)
        # A timer at the last of them is enough: what is older is due by then, too.
        self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        every = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in every if r[0] // 1000 < until]
        if due:
            value = self.value.get()[0] if self.value.exists() else self.start
            for r in due:
                value = self.step(value, dict(zip(self.columns, r[2:], strict=True)))
            self.value.update((value,))
            late = every[len(due) :]
            self.waiting.put(late) if late else self.waiting.clear()
            yield Row(**dict(zip(self.keys, key, strict=True)), value=value)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, keys: list[str], columns: list[str], start, step: Callable, kind: str) -> DataFrame:
    """The same on a stream with a watermark on ts: (keys, value) after each batch that moves the watermark past rows of the key."""
    configure(events.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    fold = OrderedFold(keys, columns, ", ".join(f"{c} {types[c]}" for c in columns), start, step, kind)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", value {kind}"
    return events.withColumn("at", F.unix_micros("ts")).groupBy(*keys).transformWithState(fold, schema, "update", "eventtime")


def timing_ewma(progress: DataFrame) -> DataFrame:
    """(run_id, key, ewma) after all timings of each run and key in order (see averaged)."""
    return fold_batch(progress, ["run_id", "key"], ["ms"], None, averaged, "double").withColumnRenamed("value", "ewma")


def ewma_stream(progress: DataFrame) -> DataFrame:
    """timing_ewma of a stream with a watermark on ts."""
    return fold_stream(progress, ["run_id", "key"], ["ms"], None, averaged, "double").withColumnRenamed("value", "ewma")


def step_state(events: DataFrame, steps: int) -> DataFrame:
    """(run_id, step, state) after a run's events in order (see stepped)."""
    states = fold_batch(events, ["run_id"], ["step", "failed"], ["pending"] * steps, stepped, "array<string>")
    return states.select("run_id", F.posexplode("value").alias("step", "state"))


def step_stream(events: DataFrame, steps: int) -> DataFrame:
    """step_state of a stream with a watermark on ts: the states of a run each time that they may have changed."""
    return fold_stream(events, ["run_id"], ["step", "failed"], ["pending"] * steps, stepped, "array<string>").withColumnRenamed("value", "states")


# ---- documents that are held


def next_insertion(touches: DataFrame, ttl: timedelta = TTL) -> DataFrame:
    """touches (doc_id, event_id, ts, inserted) with `reaped`: the first insertion of any document later than ts + ttl, the moment this touch's document goes unless it is touched again.

    Times are dealt by the hour. Within an hour a window looks ahead; past it, the first insertion of the next hour that has one stands, of which there is one row an hour.
    """
    micros, hour = F.unix_micros("ts"), 3_600_000_000
    probes = touches.withColumn("at", micros + int(ttl.total_seconds() * 1e6)).withColumn("hour", F.floor(F.col("at") / hour))
    inserted = touches.where("inserted").select(micros.alias("at")).withColumn("hour", F.floor(F.col("at") / hour))
    # From the last to the first: a frame that grows is passed over once, one that shrinks is read again for each row.
    ahead = Window.partitionBy("hour").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    both = probes.select("doc_id", "event_id", "ts", "inserted", "hour", "at", F.lit(None).cast("long").alias("seen")).unionByName(inserted.distinct().withColumn("seen", F.col("at")), allowMissingColumns=True)
    near = both.withColumn("own", F.min("seen").over(ahead)).where("seen IS NULL")
    firsts = inserted.groupBy("hour").agg(F.min("at").alias("first"))
    hours = firsts.select("hour", "first").unionByName(probes.select("hour").distinct(), allowMissingColumns=True).groupBy("hour").agg(F.min("first").alias("first"))
    later = hours.select("hour", F.min("first").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    return near.join(later, "hour").select("doc_id", "event_id", "ts", "inserted", F.timestamp_micros(F.coalesce("own", "later")).alias("reaped"))


def held_documents(touches: DataFrame, ttl: timedelta = TTL) -> DataFrame:
    """(doc_id, start, last, touches, reaped): each time a document was held, from its insertion to its last touch, and the insertion that found it too old (null: it is held still, or was replaced).

    touches: doc_id, event_id, ts, inserted. Nothing goes by itself: an insertion first drops all documents untouched for longer than ttl (not for ttl exactly), and a document that is past its time
    but not yet dropped is touched like others. A touch of a document that isn't held does nothing. An insertion of one that is held replaces it.
    """
    own = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    t = next_insertion(touches, ttl).withColumn("gone", F.coalesce(F.lag("reaped").over(own) <= F.col("ts"), F.lag("ts").over(own).isNull()))
    t = t.withColumn("part", F.sum((F.col("inserted") | F.col("gone")).cast("int")).over(own)).withColumn("next", F.lead("ts").over(own))
    s = t.groupBy("doc_id", "part").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("touches"), F.bool_or("inserted").alias("held"), F.max_by(F.struct("reaped", "next"), F.struct("ts", "event_id")).alias("end")).where("held")
    dropped = F.col("end.next").isNull() | (F.col("end.reaped") <= F.col("end.next"))
    return s.select("doc_id", "start", "last", "touches", F.when(dropped, F.col("end.reaped")).alias("reaped"))


class HeldDocuments(StatefulProcessor):
    """One shard's documents, times in microseconds. Rows of a batch are taken by their times; an insertion of another shard's document comes as a row that is not its own."""

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "doc_id long", "start long, last long, touches long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        was = dict(held)
        out = []
        went = lambda doc, reaped: out.append(Row(doc_id=doc, **dict(zip(("start", "last", "touches"), held.pop(doc), strict=True)), reaped=reaped))
        for at, _, doc, inserted, own in sorted((r["at"], r["event_id"], r["doc_id"], r["inserted"], r["own"]) for r in rows):
            if inserted:
                for d in [d for d, (_, last, _) in held.items() if last < at - self.ttl]:
                    went(d, at)
            if own and inserted:
                if doc in held:
                    went(doc, None)
                held[doc] = (at, at, 1)
            elif own and doc in held:
                held[doc] = (held[doc][0], at, held[doc][2] + 1)
        for d in was.keys() - held.keys():
            self.held.removeKey((d,))
        for d, v in held.items():
            if was.get(d) != v:
                self.held.updateValue((d,), v)
        return iter(out)

    def close(self) -> None:
        pass


def held_stream(touches: DataFrame, ttl: timedelta = TTL, shards: int = SHARDS) -> DataFrame:
    """held_documents of a stream, but for those held still: a row when a document goes. Batches are taken in the order they come.

    Documents are dealt to shards, each of which holds its own; every insertion is told to all shards, as it may drop documents of any.
    """
    configure(touches.sparkSession)
    own = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    told = F.when(F.col("inserted"), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    dealt = touches.select("doc_id", "event_id", F.unix_micros("ts").alias("at"), "inserted", F.explode(told).alias("shard")).withColumn("own", F.col("shard") == own)
    went = dealt.groupBy("shard").transformWithState(HeldDocuments(ttl), "doc_id long, start long, last long, touches long, reaped long", "append", "none")
    return went.select("doc_id", *(F.timestamp_micros(c).alias(c) for c in ("start", "last")), "touches", F.timestamp_micros("reaped").alias("reaped"))
