"""Embedding of passages and queries.

``hashed`` is a bag of words in plain expressions: each term adds to the slot
of the first byte of its SHA-256, and the vector gets unit length.  A model is
any object with ``embed(list of texts) -> list of vectors``; it is made once in
each worker and fed in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import embedding_context
from ..functions.text import keyword_terms
from ..functions.vectors import normalize, once


def with_context(text: Column, name: Column) -> Column:
    """A passage behind the words of its file name."""
    own = embedding_context(name)
    return F.when(own == "", text).otherwise(F.concat(F.lit("[File: "), own, F.lit("]\n"), text))


def hashed(text: Column, size: int) -> Column:
    slots = F.transform(keyword_terms(text), lambda t: F.pmod(F.conv(F.substring(F.sha2(t, 256), 1, 2), 16, 10).cast("int"), F.lit(size)))
    counts = once(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return normalize(counts)


def embed(rows: DataFrame, text_col: str, size: int, make_model: Callable[[], object], batch: int = 256, out_col: str = "vector") -> DataFrame:
    """``rows`` with model vectors; a wrong number or size of vectors fails the job."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for part in parts:
            out = []
            for i in range(0, len(part), batch):
                texts = part.iloc[i : i + batch].tolist()
                vectors = model.embed(texts)
                if len(vectors) != len(texts) or any(len(v) != size for v in vectors):
                    raise ValueError("the model gave vectors of another number or size")
                out.extend(vectors)
            yield pd.Series(out, dtype=object)

    return rows.withColumn(out_col, run(F.col(text_col)))


def embed_queries(queries: DataFrame, text_col: str, size: int, make_model: Callable[[], object], out_col: str = "vector") -> DataFrame:
    """``queries`` with the vectors of the model's ``embed_query(text)``: one call and one vector a query.

    A model that gives no vector, several, or one of another size fails the job;
    null texts have null vectors.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for part in parts:
            out = []
            for text in part:
                vectors = [[]] if text is None else model.embed_query(text)
                if len(vectors) != 1 or text is not None and len(vectors[0]) != size:
                    raise ValueError("the model must give one vector of the stated size for a query")
                out.append(None if text is None else vectors[0])
            yield pd.Series(out, dtype=object)

    return queries.withColumn(out_col, run(F.col(text_col)))


def not_yet_indexed(contents: DataFrame, chunks: DataFrame, chunking: str, embedding: str, forced: bool = False) -> DataFrame:
    """``contents(content_id, expected)`` with ``embed``: it has chunks and they are not all stored under both profiles."""
    stored = chunks.filter((F.col("chunking_profile") == chunking) & (F.col("embedding_profile") == embedding)).groupBy("content_id").agg(F.count(F.lit(1)).alias("stored"))
    out = contents.join(stored, "content_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
    return out.withColumn("embed", (F.col("expected") > 0) & (F.lit(forced) | (F.col("stored") != F.col("expected"))))
