"""Reconciling a listing with the catalog: added, unchanged, metadata, changed, moved, restored, missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import work_path
from .scans import numbered

KEY = ["location_id", "relative_path"]


def reconcile(catalog: DataFrame, observed: DataFrame) -> DataFrame:
    """One row a decision: ``kind, entry_id, location_id, relative_path, state, clear_missing`` and the observed metadata.

    ``catalog`` holds ``entry_id, location_id, relative_path, state, size,
    mtime, sha256``, ``observed`` the same without id and state.  A path that
    vanished gives its entry to a new path with the same hash, one to one:
    vanished paths from the last, new ones from the first.  Rows without a
    hash are never moved.  Both sides must cover the same complete locations.
    """
    old = catalog.select("entry_id", *KEY, "state", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "sha256")], F.lit(True).alias("known"))
    both = old.join(observed.select(*KEY, "size", "mtime", "sha256", F.lit(True).alias("seen")), KEY, "full_outer")
    path = work_path(catalog.sparkSession, "met")
    both.write.parquet(path)
    both = catalog.sparkSession.read.schema(both.schema).parquet(path)
    met = both.filter("known AND seen")
    vanished, new = both.filter("seen IS NULL"), both.filter("known IS NULL")

    # very many files of one hash (empty ones) are numbered by all tasks together
    claims = numbered(vanished.filter("old_sha256 IS NOT NULL"), ["location_id", "old_sha256"], ["relative_path"], "turn").withColumn("turn", F.col("turn_of") - F.col("turn") + 1)
    claims = claims.select("location_id", F.col("old_sha256").alias("sha256"), "turn", "entry_id", "state")
    takers = numbered(new.filter("sha256 IS NOT NULL"), ["location_id", "sha256"], ["relative_path"], "turn").select(*KEY, "size", "mtime", "sha256", "turn")
    moved = takers.join(claims, ["location_id", "sha256", "turn"])
    out = ["kind", "entry_id", *KEY, "state", "clear_missing", "size", "mtime", "sha256"]

    was_missing = F.col("state") == "missing"
    same = F.col("old_sha256").eqNullSafe(F.col("sha256")) & F.col("old_sha256").isNotNull()
    kind = (
        F.when(was_missing, "restored")
        .when(~same, "changed")
        .when(F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime").eqNullSafe(F.col("mtime")), "unchanged")
        .otherwise("metadata")
    )
    met = met.withColumns({"kind": kind, "clear_missing": was_missing})
    met = met.withColumn("state", F.when(F.col("kind").isin("restored", "changed"), "discovered").otherwise(F.col("state")))
    moved = moved.withColumns({"kind": F.lit("moved"), "clear_missing": was_missing, "state": F.when(was_missing, "discovered").otherwise(F.col("state"))})
    added = new.drop("entry_id", "state").join(moved.select(*KEY), KEY, "left_anti")
    added = added.withColumns({"kind": F.lit("added"), "entry_id": F.lit(None).cast("string"), "state": F.lit("discovered"), "clear_missing": F.lit(False)})
    gone = vanished.filter("state <> 'missing'").join(moved.select("entry_id"), "entry_id", "left_anti")
    gone = gone.drop("size", "mtime", "sha256").withColumns({"kind": F.lit("missing"), "state": F.lit("missing"), "clear_missing": F.lit(False), "size": F.col("old_size"), "mtime": F.col("old_mtime"), "sha256": F.col("old_sha256")})
    parts = [x.select(*out) for x in (met, moved, added, gone)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def tallies(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def apply_plan(catalog: DataFrame, plan: DataFrame, now: Column, new_id: Column) -> DataFrame:
    """The next catalog snapshot; ``missing_at`` is set when an entry goes missing and cleared when it is seen again."""
    columns = ["entry_id", *KEY, "state", "size", "mtime", "sha256", "missing_at"]
    kept = catalog.join(plan.filter("entry_id IS NOT NULL").select("entry_id"), "entry_id", "left_anti").select(*columns)
    added = plan.filter("kind = 'added'").withColumn("entry_id", new_id).withColumn("missing_at", F.lit(None).cast("timestamp"))
    old = catalog.select("entry_id", F.col("missing_at").alias("was_missing_at"))
    changed = plan.filter("kind <> 'added'").join(old, "entry_id")
    at = F.when(F.col("kind") == "missing", now).when(F.col("clear_missing"), F.lit(None)).otherwise(F.col("was_missing_at"))
    changed = changed.withColumn("missing_at", at)
    return kept.unionByName(added.select(*columns)).unionByName(changed.select(*columns))
