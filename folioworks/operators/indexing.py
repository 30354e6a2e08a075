"""Indexing documents from texts to chunk rows with deterministic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, chunking_profile, point_id, sha256
from ..functions.text import normalize_text
from ..sources.files import decoded
from ..sources.work import work_path
from .chunking import chunk_texts
from .embedding import hashed, not_yet_indexed, with_context


def named_contents(docs: DataFrame, ident: str) -> DataFrame:
    """``row, content_id, ident, text`` of the documents with text; written, so that texts are normalized once and keep their rows."""
    if "row" in docs.columns:
        return docs.filter(F.col("text").isNotNull()).select("row", "content_id", ident, "text")
    own = docs.filter(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("row"), sha256(normalize_text(F.col("text"))).alias("content_id"), ident, "text")
    path = work_path(docs.sparkSession, "contents")
    own.write.parquet(path)
    return docs.sparkSession.read.schema(own.schema).parquet(path)


def index_documents(docs: DataFrame, ident: str = "doc_id", target: int = 200, overlap: int = 20, stored: DataFrame | None = None) -> DataFrame:
    """Chunks of distinct contents: ``content_id, chunk_id, chunk_index, text, token_count, text_hash``.

    Documents of one normalized text share a content; sections are its pages.
    Documents without text give no rows, nor do contents in ``stored(content_id)``.
    """
    profile = chunking_profile(target, overlap)
    own = named_contents(docs, ident)
    # the row of the smallest id stands for a content: told without texts, which travel once
    first = own.groupBy("content_id").agg(F.min_by("row", ident).alias("row"))
    if stored is not None:
        first = first.join(stored.select("content_id").distinct(), "content_id", "left_anti")
    contents = own.join(first.select("row").hint("shuffle_hash"), "row", "left_semi")
    chunks = chunk_texts(contents, "content_id", target, overlap)
    return chunks.select("content_id", chunk_id(F.col("content_id"), F.lit(profile), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "text", "token_count", "text_hash")


def index_files(files: DataFrame, stored: DataFrame, embedding: str, size: int = 8, target: int = 200, overlap: int = 20, forced: bool = False) -> DataFrame:
    """The whole chain from bytes to points: ``content_id, chunk_id, point_id, chunk_index, text, vector``.

    ``files(file_id, name, content, sha256)`` whose bytes no longer match the
    observed hash are left out; the others are decoded, normalized, grouped by
    content, cut and chunked.  Contents whose chunks are all in
    ``stored(content_id, chunking_profile, embedding_profile)`` already are not
    embedded again.  A content has the name of its smallest file id.  Null
    contents and files without text give no rows.
    """
    profile = chunking_profile(target, overlap)
    docs = files.filter(sha256(F.col("content")) == F.col("sha256")).select("file_id", "name", decoded(F.col("content")).alias("text"))
    docs = docs.filter(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("row"), sha256(normalize_text(F.col("text"))).alias("content_id"), "file_id", "name", "text")
    path = work_path(files.sparkSession, "texts")
    docs.write.parquet(path)
    docs = files.sparkSession.read.schema(docs.schema).parquet(path)
    # counted and embedded: cut once
    own, path = index_documents(docs, "file_id", target, overlap), work_path(files.sparkSession, "chunks")
    own.write.parquet(path)
    chunks = files.sparkSession.read.schema(own.schema).parquet(path)
    names = docs.groupBy("content_id").agg(F.min_by("name", "file_id").alias("name"))
    counts = chunks.groupBy("content_id").agg(F.count(F.lit(1)).alias("expected"))
    due = not_yet_indexed(counts, stored, profile, embedding, forced).filter("embed").select("content_id")
    out = chunks.join(due, "content_id").join(names, "content_id")
    point = point_id(F.col("content_id"), F.lit(profile), F.lit(embedding), F.col("chunk_index"))
    return out.select("content_id", "chunk_id", point.alias("point_id"), "chunk_index", "text", hashed(with_context(F.col("text"), F.col("name")), size).alias("vector"))
