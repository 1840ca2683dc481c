"""Keyed state on streams against the batch forms and plain loops, rows late and in pieces."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.streaming import keyed

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def written(spark, folder, schema, pieces):
    """A stream that reads each piece as a batch of its own."""
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"p{k}"))
        for f in (folder / f"p{k}").glob("*.parquet"):
            f.rename(folder / f"{k:03}.parquet")
    import os
    import time

    for k in range(len(pieces)):
        os.utime(folder / f"{k:03}.parquet", (time.time() + k - 100,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "0*.parquet"))


def drained(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_folds_of_late_rows_agree_with_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(4)), k, "ab"[k % 2], float(rng.integers(0, 400)) / 10 - 0.5 * (k % 9 == 0), at(k), int(rng.integers(-1, 6)), bool(rng.random() < 0.1)) for k in range(160)]
    schema = "run_id long, event_id long, key string, ms double, ts timestamp, step int, failed boolean"
    batch = spark.createDataFrame(rows, schema)
    # Rows come up to 20 minutes late; the last one moves the watermark past all others.
    late = sorted(rows, key=lambda r: r[1] + rng.integers(0, 20))
    pieces = [late[k : k + 40] for k in range(0, 160, 40)] + [[(9, 999, "z", 1.0, at(10_000), 0, False)]]
    stream = written(spark, tmp_path, schema, pieces).withWatermark("ts", "30 minutes")
    got = {(r.run_id, r.key): r.ewma for r in drained(keyed.ewma_stream(stream), "ewma", "update", tmp_path / "c1").collect()}
    assert got == {(r.run_id, r.key): r.ewma for r in keyed.timing_ewma(batch).collect()}
    plain = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        plain[r[0], r[2]] = keyed.averaged(plain.get((r[0], r[2])), {"ms": r[3]})
    assert got == plain
    states = {r.run_id: r.states for r in drained(keyed.step_stream(stream, 5), "steps", "update", tmp_path / "c2").collect()}
    own = {}
    for r in keyed.step_state(batch, 5).collect():
        own.setdefault(r.run_id, {})[r.step] = r.state
    assert states == {k: [v[i] for i in range(5)] for k, v in own.items()}


def test_timings_round_the_first_and_start_again_at_zero():
    assert keyed.averaged(None, {"ms": 2.5}) == 3.0 and keyed.averaged(3.0, {"ms": 4.0}) == 4.0 and keyed.averaged(0.0, {"ms": 8.2}) == 8.0


def loop(events, ttl):
    """The rule as it stands: an insertion drops what is too old, then stores."""
    held, out = {}, []
    for doc, _, ts, inserted in sorted(events, key=lambda e: (e[2], e[1])):
        if inserted:
            out += [(d, *held.pop(d), ts) for d in [d for d, v in held.items() if v[1] < ts - ttl]]
            if doc in held:
                out.append((doc, *held.pop(doc), None))
            held[doc] = (ts, ts, 1)
        elif doc in held:
            held[doc] = (held[doc][0], ts, held[doc][2] + 1)
    return out, [(d, *v, None) for d, v in held.items()]


EDGES = [(1, 0, at(0), True), (2, 1, at(60), True), (1, 2, at(61), False), (3, 3, at(121.5), True), (1, 4, at(122), False), (1, 5, at(200), True), (4, 6, at(200 + 61), True), (5, 7, at(900), False)]


@pytest.mark.parametrize("seed", [None, 0, 1])
def test_documents_are_held_until_an_insertion_finds_them_too_old(spark, tmp_path, seed):
    """A touch exactly 60 minutes on is in time; one past it is, too, while nothing was inserted."""
    rng = np.random.default_rng(seed)
    events = EDGES if seed is None else [(int(rng.integers(12)), k, at(float(rng.integers(0, 1500)) + k / 1000), bool(rng.random() < 0.25)) for k in range(250)]
    schema = "doc_id long, event_id long, ts timestamp, inserted boolean"
    gone, still = loop(events, keyed.TTL)
    batch = [tuple(r) for r in keyed.held_documents(spark.createDataFrame(events, schema)).collect()]
    assert sorted(batch, key=str) == sorted(gone + still, key=str)
    ordered = sorted(events, key=lambda e: (e[2], e[1]))
    stream = written(spark, tmp_path, schema, [ordered[k : k + 60] for k in range(0, len(ordered), 60)])
    got = [tuple(r) for r in drained(keyed.held_stream(stream, shards=3), f"held{seed}", "append", tmp_path / "c").collect()]
    assert sorted(got, key=str) == sorted(gone, key=str)


def test_a_key_of_many_rows_is_folded_as_a_stream(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("run_id"), F.col("id").alias("event_id"), F.lit("a").alias("key"), (F.col("id") % 100).cast("double").alias("ms"), F.timestamp_seconds("id").alias("ts"))
    value = None
    for k in range(30_000):
        value = keyed.averaged(value, {"ms": float(k % 100)})
    assert [tuple(r) for r in keyed.timing_ewma(rows).collect()] == [(1, "a", value)]
    plan = keyed.timing_ewma(rows)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1
