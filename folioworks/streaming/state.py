"""Streams with keyed state: changed files between scans, and leases that end.

Both keep their state in RocksDB below the stream's checkpoint, so a stream that
starts again, on whatever executors, goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of paths, or of jobs, whose state is read and written together.
GROUPS = 256

FILE = "location_id string, relative_path string, size bigint, mtime timestamp, sha256 string, seen bigint"
CHANGE = "scan_at timestamp, kind string, location_id string, relative_path string, size bigint, mtime timestamp, sha256 string"
BEAT = "job_id bigint, event_id bigint, ts bigint, cancel boolean"
LAST = "job_id bigint, event_id bigint, ts bigint, cancel boolean, attempt bigint, told boolean"
EXPIRY = "job_id bigint, event_id bigint, attempt bigint, outcome string, expired_at timestamp"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _millis(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times, utc=True).astype("datetime64[ms, UTC]").astype("int64")


class ChangedFiles(StatefulProcessor):
    """State of a group of paths: what the last scan saw of each file."""

    KEY = ["location_id", "relative_path"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getListState("files", FILE)

    def _known(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.files.get()], columns=[*self.KEY, "size", "mtime", "sha256", "seen"])

    def _keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.files.put([tuple(r) for r in rows.itertuples(index=False)])
        else:
            self.files.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        new["seen"] = _millis(new["scan_at"])
        for seen, scan in new.sort_values("seen").groupby("seen"):
            old = self._known()
            scan = scan.drop_duplicates(self.KEY, keep="last")
            both = scan.merge(old[[*self.KEY, "sha256", "seen"]].rename(columns={"sha256": "was", "seen": "last"}), how="left", on=self.KEY)
            # rows of an earlier scan that come late change nothing
            both = both[both["last"].isna() | (both["last"] < seen)]
            fresh, changed = both["last"].isna(), both["last"].notna() & (both["was"].fillna("") != both["sha256"].fillna(""))
            out = both.assign(kind=fresh.map({True: "new", False: "changed"}))[fresh | changed]
            names = [c.split()[0] for c in CHANGE.split(", ")]
            if len(out):
                yield out[names]
            left = old.merge(both[self.KEY], how="left", on=self.KEY, indicator=True)
            kept = left[left["_merge"] == "left_only"].drop(columns="_merge")
            now = both[[*self.KEY, "size", "mtime", "sha256", "seen"]]
            self._keep(pd.concat([kept, now], ignore_index=True) if len(kept) else now)
            # the scan after this one tells what is gone
            self.handle.registerTimer(int(seen) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        gone = known[known["seen"] < now]
        if len(gone):
            self._keep(known[known["seen"] >= now])
            out = gone.assign(kind="gone", scan_at=pd.Timestamp(now, unit="ms"))
            yield out[[c.split()[0] for c in CHANGE.split(", ")]]


def changed_files(scans: DataFrame) -> DataFrame:
    """New, changed and gone files of a stream of listings ``(scan_at, location_id, relative_path, size, mtime, sha256)``.

    A scan is complete and comes in one batch, later ones with a later ``scan_at``;
    a file is ``gone`` when a later scan of any location is there and did not see it.
    ``changed`` goes by the hash.  A path that a scan has twice counts once.
    """
    own = scans.select("scan_at", "location_id", "relative_path", "size", "mtime", "sha256").withWatermark("scan_at", "0 seconds")
    own = own.withColumn("grp", F.pmod(F.xxhash64("location_id", "relative_path"), F.lit(GROUPS)))
    return own.groupBy("grp").transformWithStateInPandas(ChangedFiles(), CHANGE, "Append", "EventTime")


class Leases(StatefulProcessor):
    """State of a group of jobs: the last beat of each, and beats that the watermark has not reached."""

    def __init__(self, lease_seconds: float, most_attempts: int) -> None:
        self.lease, self.most = int(lease_seconds * 1_000_000), most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", LAST)
        self.ahead = handle.getListState("ahead", BEAT)

    def _advance(self, beats: list[tuple], now_ms: int) -> Iterator[pd.DataFrame]:
        """Takes the beats up to the watermark in order and yields the leases that ended."""
        now, out = now_ms * 1000, []
        known = {job: last for job, *last in map(tuple, self.last.get())}
        for job, event_id, ts, cancel in sorted((b for b in beats if b[2] <= now), key=lambda b: (b[2], b[1])):
            old = known.get(job, (None, None, None, 0, True))
            if not old[4] and ts - old[1] > self.lease:
                out.append((job, *old[:4]))
            known[job] = [event_id, ts, cancel, old[3] + 1, False]
        later = [b for b in beats if b[2] > now]
        waits = [b[2] for b in later]
        for job, last in known.items():
            if not last[4] and now - last[1] > self.lease:  # no beat within the lease can come any more
                out.append((job, *last[:4]))
                last[4] = True
            waits += [] if last[4] else [last[1] + self.lease]
        if known:
            self.last.put([(job, *last) for job, last in known.items()])
        self.ahead.put(later) if later else self.ahead.clear()
        if waits:
            self.handle.registerTimer(max(min(waits) // 1000 + 1, now_ms + 1))
        if out:
            found = pd.DataFrame(out, columns=["job_id", "event_id", "ts", "cancel", "attempt"])
            found["job_id"] = pd.array([f[0] for f in out], dtype="Int64")
            found["outcome"] = ["cancelled" if c else "failed" if a >= self.most else "retry_wait" for c, a in zip(found["cancel"], found["attempt"], strict=True)]
            found["expired_at"] = pd.to_datetime(found["ts"] + self.lease, unit="us")
            yield found[[c.split()[0] for c in EXPIRY.split(", ")]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beats = [tuple(b) for b in self.ahead.get()]
        for part in rows:
            jobs = [None if j is None else int(j) for j in part["job"].tolist()]
            beats += zip(jobs, part["event_id"].tolist(), part["micros"].tolist(), part["cancel"].tolist(), strict=True)
        yield from self._advance(beats, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance([tuple(b) for b in self.ahead.get()], timerValues.getCurrentWatermarkInMs())


def ended_leases(beats: DataFrame, lease_seconds: float, most_attempts: int, watermark: str = "10 minutes") -> DataFrame:
    """``job_id, event_id, attempt, outcome, expired_at`` of each beat that no other follows within the lease.

    ``beats(job_id, event_id, ts, cancel)`` may come out of order within the
    watermark.  Of several outcomes cancellation counts before exhaustion, and
    that before a retry; attempts are counted in the order of time.
    """
    own = beats.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("cancel", F.lit(False)).alias("cancel"))
    # job ids go as strings: a null among numbers would make them floats
    own = own.withWatermark("ts", watermark).withColumns({"micros": F.unix_micros("ts"), "job": F.col("job_id").cast("string"), "grp": F.pmod(F.xxhash64("job_id"), F.lit(GROUPS))})
    return own.groupBy("grp").transformWithStateInPandas(Leases(lease_seconds, most_attempts), EXPIRY, "Append", "EventTime")
