"""Scans over ranges, rank selection, hash trees and paged layouts against plain windows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioworks.operators import reports, scans
from folioworks.sources.paged import PagedTable


def events(spark, hot, seed=1, n=600):
    rng = random.Random(seed)
    rows = [(0 if hot else rng.choice([0, 0, 0, 1, 2, None]), i, rng.randrange(n // 3), rng.choice("aab") if rng.random() < 0.2 else "c", rng.choice([None, *range(50)]), rng.choice([None, *range(90)])) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, event_id long, ts long, phase string, current long, total long").repartition(3)


def plain_progress(df):
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    change = F.when(F.col("phase").eqNullSafe(F.lag("phase").over(w)), 0).otherwise(1)
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    up = Window.partitionBy("job_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.max(F.when(F.col("total").isNotNull(), F.greatest("total", "current"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumns({"shown": F.max("current").over(up), "shown_total": total, "seq": F.row_number().over(w)})


@pytest.mark.parametrize("hot", [True, False])
def test_same_as_windows(spark, hot):
    df = events(spark, hot)
    names = ["job_id", "event_id", "run", "shown", "shown_total"]
    rows = lambda d, c: sorted(map(str, d.select(*c).collect()))
    expected = plain_progress(df)
    assert rows(reports.monotone_progress(df), names) == rows(expected, names)
    assert rows(reports.event_sequence(df), ["job_id", "event_id", "seq"]) == rows(expected, ["job_id", "event_id", "seq"])


def test_a_hot_key_is_shared(spark):
    df = events(spark, True)
    parts = {r["part"]: r["count"] for r in scans.in_ranges(df, ["job_id"], ["ts", "event_id"]).groupBy("part").count().collect()}
    assert len(parts) == 4 and max(parts.values()) < 300


@pytest.mark.parametrize("key", [[], ["phase"]])
def test_rank_selection(spark, key):
    df = events(spark, False, 7)
    got = {r["phase"] if key else "all": r for r in reports.nearest_rank(df, key, "current", {"p50": 0.5, "p95": 0.95}).collect()}
    own = {}
    for r in df.collect():
        if r["current"] is not None:
            own.setdefault(r["phase"] if key else "all", []).append(r["current"])
    assert set(got) == set(own)
    for k, values in own.items():
        values.sort()
        assert [got[k][q] for q in ("p50", "p95", "largest")] == [values[min(len(values) - 1, int(q * len(values)))] for q in (0.5, 0.95)] + [values[-1]]
        assert got[k]["mean"] == pytest.approx(sum(values) / len(values))
    assert reports.nearest_rank(df.filter("false"), key, "current", {"p50": 0.5}).filter("p50 IS NOT NULL").count() == 0


def test_equal_buckets_are_not_read(spark, tmp_path):
    expected = spark.range(500).select(F.concat(F.lit("c"), F.col("id") % 100).alias("content_id"), F.concat(F.lit("p"), "id").alias("point_id"))
    actual = expected.filter("point_id <> 'p7'").unionByName(spark.createDataFrame([("c7", "x"), ("stray", "y")], expected.schema))
    e, a = reports.kept_points(expected, f"{tmp_path}/e"), reports.kept_points(actual, f"{tmp_path}/a")
    touched = {r[0] % reports.BRANCHES for r in reports.drifted_leaves(e[1], a[1]).collect()}
    assert 0 < len(touched) <= 2
    for f in Path(tmp_path, "a", "points").rglob("*.parquet"):
        if int(f.parent.name.split("=")[1]) not in touched:
            f.write_bytes(b"not to be read")
            (f.parent / f".{f.name}.crc").unlink()
    kinds = {(r["point_id"], r["kind"]) for r in reports.point_drift(e, a).filter("kind <> 'found'").collect()}
    assert kinds == {("p7", "missing"), ("x", "orphan")}
    assert reports.point_drift(e, a).filter("kind = 'found'").count() == 499
    totals = reports.consistency_totals(reports.point_drift(e, e)).first()
    assert totals["clean"] and totals["found"] == 500


def test_pages_read_few_files(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i"), F.when(F.col("id") % 10 == 0, 5).otherwise(F.col("id") % 300).alias("v"))
    plain = [tuple(r) for r in rows.orderBy("v", "i").select("v", "i").collect()]
    table = PagedTable(spark, f"file://{tmp_path}/t", "v", "i")
    table.create(rows, 20)
    seen, after = [], None
    for number in range(12):
        page = table.page(60, after)
        assert len(page.inputFiles()) <= (3 if number else 20)
        got = [(r["v"], r["i"]) for r in page.collect()]
        seen += got[:60]
        after = got[min(59, len(got) - 1)]
    assert seen == plain[: 12 * 60]
    down = [tuple(r) for r in rows.orderBy(F.desc("v"), "i").select("v", "i").collect()]
    first = [(r["v"], r["i"]) for r in table.page(60, descending=True).collect()]
    second = [(r["v"], r["i"]) for r in table.page(60, first[59], descending=True).collect()]
    assert first[:60] + second[:60] == down[:120]
    assert table.page(5, (10**6, 0)).collect() == []
