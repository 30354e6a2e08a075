"""The catalog of documents: views, filters, pages, work lists and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from ..functions.times import before_cutoff, is_due
from ..sources.keyed import last_changes

# Job states.
OPEN = ("queued", "running", "retry_wait", "cancelling")
TERMINAL = ("succeeded", "failed", "cancelled")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (a current version, a primary path)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def document_view(entries: DataFrame, locations: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Entries with their location and, where there are any, current version and content.

    ``error`` is null unless the version failed, ``content`` is null without one.
    Locations are a small dimension; Spark broadcasts them when they are under its threshold.
    """
    out = entries.join(locations, "location_id").join(versions, "version_id", "left").join(contents, "content_id", "left")
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.coalesce("error_message", F.lit("")).alias("message")))
    content = F.when(F.col("content_id").isNotNull(), F.struct(F.col("content_id").alias("id"), "page_count", "character_count"))
    return out.withColumns({"error": error, "content": content})


def indexed_members(entries: DataFrame, locations: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Indexed entries that have a current version with content."""
    own = entries.filter(F.col("state") == "indexed")
    return own.join(locations, "location_id").join(versions, "version_id").join(contents, "content_id")


def any_of(**wanted: list) -> Column:
    """Or within a field, and across fields; an empty list is no restriction."""
    out = F.lit(True)
    for name, values in wanted.items():
        if values:
            out = out & F.col(name).isin(*values)
    return out


def search_names(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term, whatever its case, in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ignoring_case(F.col(c), term)
    return rows.filter(hit)


def keyset(column: str, ident: str, value: object, last_id: object, descending: bool = False) -> Column:
    """Rows after ``(value, last_id)`` when sorted by column in the direction, then by id."""
    beyond = F.col(column) < F.lit(value) if descending else F.col(column) > F.lit(value)
    return beyond | ((F.col(column) == F.lit(value)) & (F.col(ident) > F.lit(last_id)))


def page(rows: DataFrame, column: str, ident: str, size: int, descending: bool = False, after: tuple | None = None) -> DataFrame:
    """``size`` rows and one more, which tells that there are others."""
    if after:
        rows = rows.filter(keyset(column, ident, *after, descending=descending))
    return rows.orderBy(F.desc(column) if descending else F.asc(column), ident).limit(size + 1)


def error_queue(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """Failed entries whose current version failed."""
    return entries.filter("state = 'failed'").join(versions.filter("status = 'failed'"), "version_id")


def reindexable(entries: DataFrame, location: str | None = None) -> DataFrame:
    out = entries.filter(F.col("sha256").isNotNull() & F.col("state").isin("indexed", "failed", "unsupported"))
    return out.filter(F.col("location_id") == location) if location else out


def index_worklist(entries: DataFrame, open_work: DataFrame, forced: bool = False) -> DataFrame:
    """Discovered entries without open work, one item each."""
    own = entries.filter("state = 'discovered'").select("entry_id").distinct()
    return own.join(open_work.select("entry_id").distinct(), "entry_id", "left_anti").withColumn("forced", F.lit(forced))


def reindex_worklist(entries: DataFrame, open_work: DataFrame, location: str | None = None) -> DataFrame:
    own = reindexable(entries, location).select("entry_id").distinct()
    return own.join(open_work.select("entry_id").distinct(), "entry_id", "left_anti").withColumn("forced", F.lit(True))


def due_locations(locations: DataFrame, now: Column) -> DataFrame:
    return locations.filter(F.col("enabled") & is_due(F.col("last_scan"), F.col("interval_minutes"), now))


def stale_staging(rows: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Staged rows past the cutoff whose job has ended."""
    ended = jobs.filter(F.col("status").isin(*TERMINAL)).select("job_id")
    return rows.filter(before_cutoff(F.col("staged_at"), now, hours)).join(ended, "job_id", "left_semi")


def stale_keys(rows: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Keys past the cutoff whose job is not open, or that have none."""
    open_jobs = jobs.filter(~F.col("status").isin(*TERMINAL)).select("job_id")
    return rows.filter(before_cutoff(F.col("created_at"), now, hours)).join(open_jobs, "job_id", "left_anti")


def scan_ready(locations: DataFrame, observed: DataFrame) -> DataFrame:
    """Locations whose root was seen with the sentinel they know, or with any if they know none.

    Only these may be reconciled: nothing of another becomes missing.  The
    observed sentinel is adopted where none was known.
    """
    out = locations.join(observed, "location_id").filter(F.col("observed_sentinel").isNotNull())
    out = out.filter(F.col("sentinel_id").isNull() | (F.col("sentinel_id") == F.col("observed_sentinel")))
    return out.withColumn("sentinel_id", F.coalesce("sentinel_id", "observed_sentinel"))


def carried_hashes(listing: DataFrame, prior: DataFrame) -> DataFrame:
    """``listing`` with ``carried``: the stored hash where size and time have not changed."""
    old = prior.select("location_id", "relative_path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha256").alias("old_sha"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    return listing.join(old, ["location_id", "relative_path"], "left").withColumn("carried", F.when(same, F.col("old_sha"))).drop("old_size", "old_mtime", "old_sha")


def upsert(rows: DataFrame, changes: DataFrame, key: list[str], touched: Column, order: list[str] | None = None) -> DataFrame:
    """``changes`` replace rows of the same key; ``updated_at`` of replaced and new rows is ``touched``.

    Of several changes of one key the last by ``order`` counts, else the largest row.
    ``KeyedTable`` does the same to a stored table.
    """
    order = order or [c for c in changes.columns if c not in key][:1]
    kept = rows.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(last_changes(changes, key, order).withColumn("updated_at", touched).select(*rows.columns))


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key), key, "left_anti")


def fit_geometry(points: DataFrame, size: int, distance: str) -> DataFrame:
    """Points with ``accepted``: their vectors have the collection's size and distance."""
    return points.withColumn("accepted", (F.size("vector") == size) & (F.col("distance") == distance))


def redacted(values: Column) -> Column:
    """A string map with the values of sensitive keys hidden."""
    # Sensitive keys.
    keys = ("api_key", "openai_api_key", "password", "secret", "token", "authorization", "database_url", "prompt", "question", "answer", "evidence", "document_text", "embedding")
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*keys), F.lit("***redacted***")).otherwise(v))


def job_projection(jobs: DataFrame) -> DataFrame:
    """Jobs with their target resource and whether their error may be retried."""
    kind = F.when(F.col("location_id").isNotNull(), "source_location").when(F.col("entry_id").isNotNull(), "catalog_entry")
    retryable = F.when(F.col("error_code").isNotNull(), F.coalesce(F.col("error_class").isin("transient", "internal_unclassified"), F.lit(False)))
    return jobs.withColumns({"target_type": kind, "target_id": F.coalesce("location_id", "entry_id"), "retryable": retryable})
