"""Streams with state, and tables that are changed by key."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from folioworks.operators.catalog import upsert
from folioworks.operators.reports import expired_leases
from folioworks.sources.keyed import KeyedTable
from folioworks.streaming.jobs import follow_files
from folioworks.streaming.state import Leases, ended_leases, rocks_state

T0 = datetime(2025, 1, 1)
SCAN = "scan_at timestamp, location_id string, relative_path string, size long, mtime timestamp, sha256 string"


def test_files_between_scans(spark, tmp_path):
    scans = [
        {"a": "1", "b": "1", "c": "1"},
        {"a": "1", "b": "2", "d": "1"},  # b changed, c gone, d new
        {"d": "1", "c": "9"},  # a and b gone, c is back
        {},  # a scan that saw another location only
    ]
    source, seen = tmp_path / "in", []
    for n, files in enumerate(scans):
        at = T0 + timedelta(hours=n)
        rows = [(at, "l", p, 1, at, h) for p, h in files.items()] + [(at, "other", "x", 1, T0, "x")] * 2
        spark.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCAN).parquet(str(source))
        table = KeyedTable(spark, f"file://{tmp_path}/out", ("location_id", "relative_path"), ("scan_at",), 4)
        if not n:
            table.create(spark.createDataFrame([], SCAN))
        follow_files(stream, table, f"file://{tmp_path}/state")
        seen.append({r["relative_path"]: r["sha256"] for r in table.read().collect() if r["location_id"] == "l"})
    assert seen == scans


def beats_of(spark, rows):
    return spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, cancel boolean")


def test_leases_in_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows, n = [], 0
    for job in range(12):
        at = T0
        for _ in range(rng.randrange(1, 30)):
            at += timedelta(minutes=rng.choice([5, 20, 59, 60, 61, 200]), microseconds=rng.randrange(999))
            rows.append((job, n, at, rng.random() < 0.2))
            n += 1
    rows.sort(key=lambda r: r[2])
    end = rows[-1][2]
    # some beats come a few minutes late, in a later batch
    by_arrival = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randrange(9)))
    found, size = [], len(rows) // 5 + 1
    for batch in range(5):
        beats_of(spark, by_arrival[batch * size : (batch + 1) * size]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id long, event_id long, ts timestamp, cancel boolean").parquet(str(tmp_path / "in"))

        def write(df, _, found=found):
            found += [(r["job_id"], r["event_id"], r["attempt"], r["outcome"], r["expired_at"]) for r in df.collect()]

        with rocks_state(spark):
            out = ended_leases(stream, 3600, 4)
            out.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    # what the watermark has not reached is not decided yet
    until = end - timedelta(minutes=10, seconds=1)
    batch = expired_leases(beats_of(spark, rows), 3600, 4).filter(F.col("ts") + F.expr("INTERVAL 1 HOUR") < F.lit(until))
    expected = {(r["job_id"], r["event_id"], r["attempt"], r["outcome"]) for r in batch.collect()}
    last = {}
    for job, event, ts, cancel in rows:
        last[job] = (event, ts, cancel, last.get(job, (0, 0, 0, 0))[3] + 1)
    for job, (event, ts, cancel, attempt) in last.items():
        if ts + timedelta(hours=1) < until:
            expected.add((job, event, attempt, "cancelled" if cancel else "failed" if attempt >= 4 else "retry_wait"))
    assert len(found) == len(set(found)) and {f[:4] for f in found} == expected
    assert all(at == next(r[2] for r in rows if r[1] == event) + timedelta(hours=1) for _, event, _, _, at in found)


def test_changes_by_key(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("n"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", ("k",), ("n",), 16)
    table.create(rows)
    times = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "t").rglob("*.parquet")}
    before = times()
    changes = spark.createDataFrame([(5, "b", 2), (5, "c", 3), (5, "late", 0), (999, "new", 2), (7, None, 2)], "k long, v string, n int").withColumn("gone", F.col("v").isNull())
    for _ in range(2):
        table.change(changes, deleted="gone")
        got = {r["k"]: r["v"] for r in table.read().collect()}
        assert len(got) == 400 and (got[5], got[999], got[8]) == ("c", "new", "a") and 7 not in got
    after = times()
    kept = [p for p in before if p in after]
    assert len(kept) >= 16 - 4 and all(after[p] == before[p] for p in kept)
    table.change(changes.filter("k = 0"), deleted="gone")
    assert times() == after


def test_repeated_changes_of_one_key(spark):
    rows = spark.createDataFrame([(1, "a", 0, T0), (2, "a", 0, T0)], "k long, v string, n int, updated_at timestamp")
    changes = spark.createDataFrame([(2, "b", 1), (2, "c", 2), (2, "b", 1), (3, "d", 1)], "k long, v string, n int")
    got = upsert(rows, changes, ["k"], F.lit(T0 + timedelta(days=1)), ["n"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]


class Held:
    """Stands for a handle with list states and timers."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):  # noqa: N802
        return Held()

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_leases_of_many_jobs_share_their_state():
    handle, leases = Held(), Leases(3600, 2)
    leases.init(handle)
    hour, jobs = 3_600_000_000, [*range(2**60, 2**60 + 99), None]
    part = pd.DataFrame({"job": [None if j is None else str(j) for j in jobs] * 2, "event_id": range(200), "micros": [n * 1000 + b * 3 * hour for b in range(2) for n in range(100)], "cancel": False})
    handle.now = 0
    assert list(leases.handleInputRows((7,), iter([part]), handle)) == []
    handle.now = 2 * 3_600_000
    first = pd.concat(leases.handleExpiredTimer((7,), handle, None))
    assert first["job_id"].astype(object).where(first["job_id"].notna(), None).tolist() == jobs and set(first["outcome"]) == {"retry_wait"}
    handle.now = 5 * 3_600_000
    last = pd.concat(leases.handleExpiredTimer((7,), handle, None))
    assert len(last) == 100 and set(last["outcome"]) == {"failed"} and set(last["attempt"]) == {2}
    assert list(leases.handleExpiredTimer((7,), handle, None)) == []
    # one read and one write of each state a call, not of each job
    assert leases.last.calls + leases.ahead.calls <= 16


def test_changes_are_computed_once(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ("k",), ("n",), 4)
    table.create(spark.createDataFrame([(1, 0, 0)], "k long, v long, n int"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    table.change(spark.range(1, 21).select(counted("id").alias("k"), F.col("id").alias("v"), F.lit(1).alias("n")))
    assert seen.value == 20 and sorted(r["v"] for r in table.read().collect()) == list(range(1, 21))
