"""Duplicates, comparisons, coverage, consistency, retention and job statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import backup_time, day_bucket, month_bucket, week_bucket
from ..functions.vectors import percent
from .scans import numbered, progress


def duplicate_groups(members: DataFrame) -> DataFrame:
    """``kind, group_hash, members``: equal bytes (exact), and equal text of at least two different files (text)."""
    exact = members.groupBy(F.col("sha256").alias("group_hash")).agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    text = members.groupBy(F.col("text_hash").alias("group_hash")).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("sha256").alias("files")).filter("members >= 2 AND files >= 2")
    out = exact.withColumn("kind", F.lit("exact")).unionByName(text.drop("files").withColumn("kind", F.lit("text")))
    return out.select("kind", "group_hash", "members")


def duplicate_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of each group with their group's kind and hash."""
    exact = members.join(groups.filter("kind = 'exact'").select("kind", F.col("group_hash").alias("sha256")), "sha256").withColumn("group_hash", F.col("sha256"))
    text = members.join(groups.filter("kind = 'text'").select("kind", F.col("group_hash").alias("text_hash")), "text_hash").withColumn("group_hash", F.col("text_hash"))
    return exact.unionByName(text, allowMissingColumns=False)


def compare_locations(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source`` rows with ``action, reason, target_path, target_sha256``, within each location.

    Same path and bytes: present; same path, other bytes: conflict; same bytes
    elsewhere, then same text: review; else copy.  Of several targets the
    lowest path counts, found before the join so that it never multiplies rows.
    """
    t = target.select("location_id", F.col("relative_path").alias("t_path"), F.col("sha256").alias("t_sha"), F.col("text_hash").alias("t_text"))
    by_sha = t.groupBy("location_id", F.col("t_sha").alias("sha256")).agg(F.min("t_path").alias("sha_path"))
    by_text = t.groupBy("location_id", F.col("t_text").alias("text_hash")).agg(F.min(F.struct("t_path", "t_sha")).alias("m"))
    by_text = by_text.select("location_id", "text_hash", F.col("m.t_path").alias("text_path"), F.col("m.t_sha").alias("text_sha"))
    out = source.join(t.select("location_id", F.col("t_path").alias("relative_path"), F.col("t_sha").alias("path_sha")), ["location_id", "relative_path"], "left")
    out = out.join(by_sha, ["location_id", "sha256"], "left").join(by_text, ["location_id", "text_hash"], "left")
    here, same = F.col("path_sha").isNotNull(), F.col("path_sha") == F.col("sha256")
    case = lambda a, b, c, d, e: F.when(here & same, a).when(here, b).when(F.col("sha_path").isNotNull(), c).when(F.col("text_path").isNotNull(), d).otherwise(e)
    none = F.lit(None).cast("string")
    return out.withColumns(
        {
            "action": case(F.lit("already_present"), F.lit("conflict"), F.lit("manual_review"), F.lit("manual_review"), F.lit("copy")),
            "reason": case(F.lit("exact"), F.lit("path_conflict"), F.lit("renamed"), F.lit("text_equivalent"), F.lit("missing")),
            "target_path": case(F.col("relative_path"), F.col("relative_path"), F.col("sha_path"), F.col("text_path"), none),
            "target_sha256": case(F.col("path_sha"), F.col("path_sha"), F.col("sha256"), F.col("text_sha"), none),
        }
    ).drop("path_sha", "sha_path", "text_path", "text_sha")


def comparison_summary(items: DataFrame) -> DataFrame:
    """Per location: counts by action, covered ones, and their percentage."""
    n = lambda a: F.count_if(F.col("action") == a)
    out = items.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("total"), n("already_present").alias("present"), n("manual_review").alias("review"), n("conflict").alias("conflict"), n("copy").alias("to_copy")
    )
    out = out.withColumn("covered", F.col("present") + F.col("review"))
    return out.withColumn("covered_percent", percent(F.col("covered"), F.col("total")))


def coverage(locations: DataFrame, entries: DataFrame) -> DataFrame:
    """Every location with its entries by state (a map) and in all."""
    counts = entries.groupBy("location_id", "state").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("location_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("by_state"), F.sum("n").alias("total"))
    out = locations.select("location_id").join(maps, "location_id", "left")
    return out.withColumns({"by_state": F.coalesce("by_state", F.create_map().cast("map<string,bigint>")), "total": F.coalesce("total", F.lit(0).cast("long"))})


def orphan_contents(contents: DataFrame, entries: DataFrame) -> DataFrame:
    """Contents that no indexed entry refers to."""
    return contents.join(entries.filter("state = 'indexed' AND content_id IS NOT NULL").select("content_id"), "content_id", "left_anti")


def superseded_collections(points: DataFrame, prefix: str, active: str) -> DataFrame:
    return points.filter(F.col("collection").startswith(prefix) & (F.col("collection") != active)).select("collection").distinct()


#: Buckets by content of the hash tree, and branches of its first level.
LEAVES, BRANCHES = 1 << 14, 16


def point_tree(points: DataFrame) -> DataFrame:
    """``leaf, n, total, mixed``: by bucket of contents the number of (distinct) points, and the sum and xor of their hashes.

    A store may keep this table beside its points and change it with them.
    """
    own = points.withColumn("h", F.xxhash64("content_id", "point_id"))
    spread = F.xxhash64("h", F.lit(1)).cast("decimal(38,0)")
    return own.groupBy(leaf_of(F.col("content_id")).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(spread).alias("total"), F.bit_xor("h").alias("mixed"))


def leaf_of(content: Column) -> Column:
    return F.pmod(F.xxhash64(content), F.lit(LEAVES)).cast("int")


def drifted_leaves(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``leaf`` of the buckets in which two trees differ; whole branches that agree are left out first."""

    def above(tree: DataFrame) -> DataFrame:
        return tree.groupBy(F.pmod("leaf", F.lit(BRANCHES)).alias("branch")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))

    def unlike(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
        both = a.join(b.select(on, *[F.col(c).alias(f"o_{c}") for c in ("n", "total", "mixed")]), on, "full_outer")
        return both.filter(~(F.col("n").eqNullSafe(F.col("o_n")) & F.col("total").eqNullSafe(F.col("o_total")) & F.col("mixed").eqNullSafe(F.col("o_mixed")))).select(on)

    branches = unlike(above(expected), above(actual), "branch")
    inside = lambda t: t.withColumn("branch", F.pmod("leaf", F.lit(BRANCHES))).join(F.broadcast(branches), "branch", "left_semi")  # noqa: E731  at most BRANCHES rows
    return unlike(inside(expected), inside(actual), "leaf")


def kept_points(points: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Distinct points stored by branch, and their tree, stored beside them; a new path."""
    spark = points.sparkSession
    own = points.select("content_id", "point_id").distinct().withColumn("branch", F.pmod(leaf_of(F.col("content_id")), F.lit(BRANCHES)))
    own.repartition("branch").write.partitionBy("branch").parquet(f"{path}/points")
    stored = spark.read.schema("content_id string, point_id string, branch int").parquet(f"{path}/points")
    point_tree(stored).write.parquet(f"{path}/tree")
    return stored, spark.read.parquet(f"{path}/tree")


def point_drift(expected: tuple[DataFrame, DataFrame], actual: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Point ids that only one side has, for contents with expected points: ``content_id, point_id, kind``.

    Both sides are points with their tree (``kept_points``).  Only points of buckets
    whose trees differ are compared, and only their branches of the actual
    points are read; the other expected points are ``found``.
    """
    (e, mine), (a, theirs) = expected, actual
    leaves = sorted(r[0] for r in drifted_leaves(mine, theirs).collect())  # at most LEAVES numbers
    inside = leaf_of(F.col("content_id")).isin(leaves) if leaves else F.lit(False)
    near = e.filter(inside).select("content_id", "point_id")
    there = a.filter(F.col("branch").isin(sorted({x % BRANCHES for x in leaves})) & inside) if leaves else a.filter(F.lit(False))
    there = there.select("content_id", "point_id").join(near.select("content_id").distinct(), "content_id", "left_semi")
    both = near.withColumn("e", F.lit(True)).join(there.withColumn("a", F.lit(True)), ["content_id", "point_id"], "full_outer")
    compared = both.select("content_id", "point_id", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "orphan").otherwise("found").alias("kind"))
    return compared.unionByName(e.filter(~inside).select("content_id", "point_id", F.lit("found").alias("kind")))


def consistency_totals(drift: DataFrame) -> DataFrame:
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return drift.agg(
        F.count_distinct("content_id").alias("contents"),
        n("found", "missing").alias("expected"),
        n("found").alias("found"),
        n("missing").alias("missing"),
        n("orphan").alias("orphan"),
        F.count_distinct(F.when(F.col("kind") != "found", F.col("content_id"))).alias("drifted"),
        (n("missing", "orphan") == 0).alias("clean"),
    )


def scan_summary(jobs: DataFrame) -> DataFrame:
    """By root job: children indexed, failed, still to do, in all."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    own = jobs.filter("root_job_id IS NOT NULL")
    return own.groupBy("root_job_id").agg(n("succeeded").alias("indexed"), n("failed").alias("failed"), n("queued", "running", "retry_wait").alias("remaining"), F.count(F.lit(1)).alias("total"))


def retained(backups: DataFrame, daily: int, weekly: int, monthly: int) -> DataFrame:
    """Ids of the newest backup in each of the most recent days, ISO weeks and months.

    ``backups(id, made_at)``; there is one row a backup, so the bucket ranking is small.
    """
    parts = []
    for bucket, n in ((day_bucket, daily), (week_bucket, weekly), (month_bucket, monthly)):
        own = backups.withColumn("bucket", bucket(F.col("made_at")))
        newest = own.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("made_at"), "id"))).filter("k = 1")
        parts.append(newest.withColumn("r", F.row_number().over(Window.orderBy(F.desc("bucket")))).filter(F.col("r") <= n).select("id"))
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def pruned(backups: DataFrame, kept: DataFrame) -> DataFrame:
    """The other backups, oldest first."""
    return backups.join(kept, "id", "left_anti").orderBy("made_at", "id")


def completed_sets(names: DataFrame, markers: DataFrame) -> DataFrame:
    """Valid backup names that have a completion marker, newest first."""
    own = names.withColumn("made_at", backup_time(F.col("name"))).filter("made_at IS NOT NULL")
    return own.join(markers.select("name").distinct(), "name", "left_semi").orderBy(F.desc("made_at"), "name")


def nearest_rank(values: DataFrame, key: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles ``sorted[min(n - 1, int(q * n))]``, the largest value and the mean.

    Ranks are numbered over ranges of values, so a key of any size, or all rows without a key, are shared by all tasks.
    """
    own = numbered(values.filter(F.col(column).isNotNull()).select(*key, column), key, [column], "_rank")
    at = lambda q: F.least(F.col("_rank_of") - 1, F.floor(F.lit(q) * F.col("_rank_of")))
    picks = [F.max(F.when(F.col("_rank") - 1 == at(q), F.col(column))).alias(name) for name, q in quantiles.items()]
    return own.groupBy(*key).agg(*picks, F.max(column).alias("largest"), F.avg(column).alias("mean"))


def event_sequence(events: DataFrame) -> DataFrame:
    """Numbers from 1 without gaps in each job, by time and id."""
    return numbered(events, ["job_id"], ["ts", "event_id"], "seq").drop("seq_of")


def monotone_progress(events: DataFrame) -> DataFrame:
    """Progress that never falls inside a run of one phase; the total never falls and is never below it."""
    return progress(events, ["job_id"], ["ts", "event_id"], "phase", "current", "total")


def verify_sums(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a checksum manifest: checked, mismatched, missing, and whether all is well."""
    both = manifest.join(actual.withColumnRenamed("sha256", "now"), "path", "left")
    n = lambda c: F.count_if(c)
    out = both.agg(n(F.col("now").isNotNull()).alias("checked"), n(F.col("now") != F.col("sha256")).alias("mismatched"), n(F.col("now").isNull()).alias("missing"))
    return out.withColumn("ok", (F.col("mismatched") == 0) & (F.col("missing") == 0))


def artifact_inventory(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced artifacts with their hash, or a warning."""
    own = contents.select("address").distinct().join(files, "address", "left")
    return own.withColumn("warning", F.when(F.col("sha256").isNull(), "missing_artifact"))


def dedup_contents(contents: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return contents.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def expired_leases(beats: DataFrame, lease_seconds: int, most_attempts: int) -> DataFrame:
    """Silences longer than the lease: ``job_id, event_id, ts, gap_seconds, outcome``.

    Of several outcomes cancellation counts before exhaustion, and that before a retry.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    out = beats.withColumns({"attempt": F.row_number().over(w), "next": F.lead("ts").over(w)})
    gap = F.unix_micros(F.col("next").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    out = out.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > lease_seconds)
    outcome = F.when(F.col("cancel"), "cancelled").when(F.col("attempt") >= most_attempts, "failed").otherwise("retry_wait")
    return out.withColumn("outcome", outcome)


def overlapping_roots(locations: DataFrame, root: Column) -> DataFrame:
    """Pairs of enabled locations of one path family of which one root holds the other.

    A root is joined to its own ancestors, an equality join, so no pairs of
    unrelated roots are made.  ``root`` is a comparable root (see ``comparable_root``).
    """
    own = locations.filter("enabled").select("location_id", "family", root.alias("root"))
    parts = F.split("root", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    inner = own.select("family", F.col("location_id").alias("inner_id"), F.explode(F.array_distinct(above)).alias("root"))
    out = inner.join(own.withColumnRenamed("location_id", "outer_id"), ["family", "root"]).filter("inner_id <> outer_id")
    return out.select(F.least("inner_id", "outer_id").alias("a"), F.greatest("inner_id", "outer_id").alias("b")).distinct()
