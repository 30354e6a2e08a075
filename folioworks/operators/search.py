"""Hybrid top-k search for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_terms, snippet
from ..functions.vectors import rrf_term
from ..sources.work import work_path
from .vector_index import build_index, search_index


def ranked(rows: DataFrame, k: int, rank: str = "rank", decimals: int = 6) -> DataFrame:
    """The k best rows of each query by score (rounded, so that order does not hang on the last bits), then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return rows.withColumn("score", F.round("score", decimals)).withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_of(leg: str, found: DataFrame, k: int) -> DataFrame:
    return ranked(found.filter(F.col("leg") == leg).select("query_id", "point_id", "score"), k)


def vector_leg(points: DataFrame, queries: DataFrame, k: int, distance: str = "cosine", threshold: float | None = None) -> DataFrame:
    """``query_id, point_id, score, rank`` of the k nearest of ``points(point_id, vector)``, as if all pairs were compared."""
    return best_of("vector", search_index(build_index(points.select("point_id", "vector"), distance), queries, k, threshold), k)


def keyword_leg(points: DataFrame, queries: DataFrame, k: int, distance: str = "cosine") -> DataFrame:
    """The k nearest points that have one of the query's terms."""
    return best_of("keyword", search_index(build_index(points.select("point_id", "vector", "terms"), distance), queries, k, legs=("keyword",)), k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion; the score stays the vector score; ties keep the vector leg's order first."""
    both = vector.select("query_id", "point_id", "score", F.col("rank").alias("vr"), F.lit(None).cast("int").alias("kr")).unionByName(
        keyword.select("query_id", "point_id", "score", F.lit(None).cast("int").alias("vr"), F.col("rank").alias("kr"))
    )
    one = both.groupBy("query_id", "point_id").agg(F.max("score").alias("score"), F.max("vr").alias("vr"), F.max("kr").alias("kr"))
    one = one.withColumn("fused", rrf_term(F.col("vr")) + rrf_term(F.col("kr")))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("vr"), F.asc_nulls_last("kr"))
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(points: DataFrame, queries: DataFrame, k: int, distance: str = "cosine", threshold: float | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Both legs within the allowed contents, searched in one pass and fused; a query without terms has its vector leg alone."""
    own = points.select("point_id", "vector", "terms")
    if allowed is not None:
        marked = allowed.select("content_id", F.lit(True).alias("allowed")).distinct()
        own = points.select("point_id", "content_id", "vector", "terms").join(marked, "content_id", "left").select("point_id", "vector", "terms", "allowed")
    found = search_index(build_index(own, distance), queries, k, threshold, legs=("vector", "keyword"))
    path = work_path(points.sparkSession, "hits")
    found.write.parquet(path)
    found = points.sparkSession.read.schema(found.schema).parquet(path)
    return fuse(best_of("vector", found, k), best_of("keyword", found, k), k)


def query_terms(text: Column) -> Column:
    return F.array_distinct(expand_terms(text))


def allowed_contents(entries: DataFrame, locations: list[str] | None = None, extensions: list[str] | None = None, current_only: bool = True) -> DataFrame:
    """Contents that the filters leave."""
    out = entries.filter(F.col("content_id").isNotNull())
    if locations:
        out = out.filter(F.col("location_id").isin(*locations))
    if extensions:
        out = out.filter(F.col("extension").isin(*extensions))
    if current_only:
        out = out.filter("state = 'indexed'")
    return out.select("content_id").distinct()


def resolved_paths(entries: DataFrame) -> DataFrame:
    """``content_id, primary, n_paths``: a content's first entry by time and id, and how many it has; missing ones too.

    The primary path is an aggregate, so a content of very many entries is one small
    row; ``path_rows`` lists them all.
    """
    first = F.min(F.struct("created_at", "entry_id", "location_id", "display_path", "state"))
    return entries.groupBy("content_id").agg(first.alias("primary"), F.count(F.lit(1)).alias("n_paths"))


def path_rows(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``content_id, entry_id, location_id, display_path, state, is_primary``: a row for every path of the contents hit."""
    own = entries.join(hits.select("content_id").distinct(), "content_id", "left_semi")
    first = resolved_paths(own).select("content_id", F.col("primary.entry_id").alias("first_id"))
    return own.join(first, "content_id").select("content_id", "entry_id", "location_id", "display_path", "state", (F.col("entry_id") == F.col("first_id")).alias("is_primary"))


def availability(state: Column) -> Column:
    """``current``, ``missing`` or ``historical`` by the primary path's state."""
    return F.when(state == "indexed", "current").when(state == "missing", "missing").otherwise("historical")


def search(points: DataFrame, queries: DataFrame, entries: DataFrame, k: int, allowed: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Hits with text, snippet, primary path, number of paths and availability."""
    hits = hybrid(points, queries, k, threshold=threshold, allowed=allowed)
    out = hits.join(points.select("point_id", "content_id", "text"), "point_id").join(resolved_paths(entries), "content_id", "left")
    return out.withColumns({"snippet": snippet(F.col("text")), "availability": availability(F.col("primary.state"))})
