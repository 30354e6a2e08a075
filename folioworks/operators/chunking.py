"""Sections of text and CSV files, page-aware chunks with overlap."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.ids import sha256
from ..functions.text import by_parts, tokens
from ..sources.files import decoded


def _parts(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n")


def text_sections(docs: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """``ident, index, section``: the parts between blank lines, trimmed, empty ones dropped."""
    parts = F.transform(_parts(F.col(text)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return docs.select(ident, F.posexplode(F.filter(parts, lambda s: s != "")).alias("index", "section"))


def csv_sections(rows: DataFrame, ident: str, order: str, cells: str = "cells", size: int = 100) -> DataFrame:
    """``ident, index, section`` from parsed rows (arrays of cells in file order, the first row as header).

    Rows of blanks are dropped; a section has the header line and up to
    ``size`` rows as ``name: value`` joined by `` | ``; cells beyond the header
    are dropped; a header alone is one section.
    """
    full = rows.filter(F.exists(cells, lambda c: F.trim(c) != ""))
    numbered = full.withColumn("row", F.row_number().over(Window.partitionBy(ident).orderBy(order)) - 1)
    header = numbered.filter("row = 0").select(ident, F.col(cells).alias("header"))
    data = numbered.filter("row > 0").join(header, ident)
    trimmed = lambda a: F.transform(a, lambda c: F.trim(c))
    width = F.least(F.size("header"), F.size(cells))
    pairs = F.zip_with(F.slice(trimmed(F.col("header")), F.lit(1), width), F.slice(trimmed(F.col(cells)), F.lit(1), width), lambda h, c: F.concat(h, F.lit(": "), c))
    data = data.select(ident, "row", F.floor((F.col("row") - 1) / size).cast("int").alias("index"), F.array_join(pairs, " | ").alias("line"))
    bodies = data.groupBy(ident, "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("body"))
    out = header.join(bodies, ident, "left")
    line = F.array_join(trimmed(F.col("header")), " | ")
    section = F.when(F.col("body").isNull(), line).otherwise(F.concat(line, F.lit("\n"), F.col("body")))
    return out.select(ident, F.coalesce("index", F.lit(0)).alias("index"), section.alias("section"))


def extraction_status(ext: Column, content: Column, text: Column | None = None) -> Column:
    """``ok`` or why a file's bytes give no text (``text``, where it is decoded already); never an error of the job."""
    known = ext.isin("txt", "md", "csv")
    text = decoded(F.when(known, content.cast("binary"))) if text is None else text
    return (
        F.when(~known, "unsupported_type")
        .when(content.isNull() | (F.length(content) == 0), "empty_file")
        .when(text.isNull(), "unsupported_encoding")
        .when(~F.rlike(text, F.lit(r"\S")), "no_extractable_text")
        .otherwise("ok")
    )


#: Stands between the tokens of a page on their way to Python; white space, so no token of words holds it.
BETWEEN = "\x1f"
CHUNK = StructType().add("text", "string").add("token_count", "long").add("page_start", "integer").add("page_end", "integer")


def cut_pages(pages: list[list[str]], numbers: list[int | None], target: int, overlap: int) -> list[tuple[str, int, int | None, int | None]]:
    """``text, token_count, page_start, page_end`` of a document's chunks.

    Small pages go together up to the target, a larger one stands alone; each pack
    is cut into windows of ``target`` tokens in steps of ``target - overlap``.
    """
    packs: list[tuple[list[str], list[int]]] = []
    full = True
    for own, number in zip(pages, numbers, strict=True):
        large = len(own) > target
        if full or large or len(packs[-1][0]) + len(own) > target:
            packs.append(([], []))
        packs[-1][0].extend(own)
        packs[-1][1].extend([] if number is None else [number])
        full = large
    out = []
    for own, seen in packs:
        windows = 1 + max(0, -(-(len(own) - target) // (target - overlap)))
        for start in range(0, windows * (target - overlap), target - overlap):
            part = own[start : start + target]
            out.append((" ".join(part), len(part), min(seen, default=None), max(seen, default=None)))
    return out


def _cut(target: int, overlap: int, between: str | None = None) -> Callable[[Column, Column], Column]:
    """Chunks of documents from the arrays of their pages' texts and numbers (null: no page has one).

    Tokens stand between white space, which Python knows as the text rules do, or ``between``; pages without are skipped.
    """

    @F.arrow_udf(ArrayType(CHUNK))
    def cut(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        def part(rows: pa.StructArray) -> pa.Array:
            ends, flat = [0], []
            for own, which in zip(rows.field("texts").to_pylist(), rows.field("numbers").to_pylist(), strict=True):
                own = own or []
                pages = [(toks, n) for t, n in zip(own, which or [None] * len(own), strict=True) if (toks := t.split(between))]
                flat += cut_pages([p[0] for p in pages], [p[1] for p in pages], target, overlap)
                ends.append(len(flat))
            columns = zip(*flat, strict=True) if flat else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            chunks = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=CHUNK.names)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)

        return by_parts(pa.StructArray.from_arrays([texts, numbers], names=["texts", "numbers"]), part, 64)

    return cut


def _chunk_rows(docs: DataFrame, ident: str, chunks: Column) -> DataFrame:
    out = docs.select(ident, chunks.alias("chunks")).select(ident, F.posexplode("chunks").alias("chunk_index", "c"))
    return out.select(ident, "chunk_index", "c.text", "c.token_count", "c.page_start", "c.page_end", sha256(F.col("c.text")).alias("text_hash"))


def chunk_pages(pages: DataFrame, ident: str, target: int, overlap: int, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """Chunks of documents from ``pages(ident, index, page_number, text)``.

    ``tokenize`` turns a text into an array of tokens (words by default) without
    ``BETWEEN``; its id belongs into the chunking profile.

    ``ident, chunk_index, text, token_count, page_start, page_end, text_hash``.
    Blank pages are skipped but numbers of the pages around them stay.  A document's
    pages meet once, and are packed and cut there in time linear in their tokens.
    """
    own = pages.withColumn("toks", tokenize(F.col("text"))).filter(F.size("toks") > 0)
    row = F.struct("index", "page_number", F.array_join("toks", BETWEEN).alias("own"))
    docs = own.groupBy(ident).agg(F.array_sort(F.collect_list(row), lambda a, b: a["index"] - b["index"]).alias("pages"))
    return _chunk_rows(docs, ident, _cut(target, overlap, BETWEEN)(F.transform("pages", lambda p: p["own"]), F.transform("pages", lambda p: p["page_number"].cast("int"))))


def chunk_texts(docs: DataFrame, ident: str, target: int, overlap: int) -> DataFrame:
    """As ``chunk_pages`` over the ``text_sections`` of ``docs(ident, text)``, one row a document, which stays where it is."""
    return _chunk_rows(docs, ident, _cut(target, overlap)(_parts(F.col("text")), F.lit(None).cast("array<int>")))
