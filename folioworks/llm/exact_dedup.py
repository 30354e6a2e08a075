"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every row to one cell of a Bloom filter; cells are counted with
partial sums, so a text of very many copies sends one count a task, and the
cells that at least two rows hit are aggregated into bitmaps of ``BITMAP`` bits.
Pass 2 probes every row against those bitmaps (a broadcast of at most
``MAX_FILTER_BITS`` bits).  A row with an unhit cell cannot have a copy, so it
passes straight through; only the others are shuffled on their SHA-256 and
resolved exactly.  A filter that is too small for its input only sends more
rows through the exact path, it never changes a result.

Texts are equal when they are identical after lower-casing A-Z (other letters
keep their case).  Null texts count as empty, and empty texts are equal to each
other.  Of equal texts the row with the largest id stays; a null id ranks below
any other, and a group of null ids alone keeps all its rows.  Rows that repeat
both id and text carry the same decision.  An empty table gives an empty
result.  Other columns pass through; a clash with an output column is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one bitmap, and of all: about 32 a row up to 33 million rows; a fifth of the rows that have no copy go the exact way at 200 million.
BITMAP, MAX_FILTER_BITS = 1 << 15, 1 << 30
OUT = ("keep_id", "group_size", "kept", "text_sha256")
#: Columns used on the way, beside the input's own.
HELPERS = ("maybe_repeated", "filter_part", "filter_bits", "row_part")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() equals the A-Z mapping where every character is one byte
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    return F.sha2(fold_ascii(text), 256)


def filter_bits_for(rows: int, most: int = MAX_FILTER_BITS) -> int:
    """About 32 bits a row, a power of two from ``BITMAP`` to ``most``."""
    bits = BITMAP
    while bits < 32 * rows and bits < most:
        bits *= 2
    return bits


def _cell(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def repeat_filter(digests: DataFrame, digest_col: str, bits: int) -> DataFrame:
    """Pass 1: ``(part, bits)``, bitmaps of the cells hit twice or more; at most one row for each ``BITMAP`` bits."""
    often = digests.select(_cell(F.col(digest_col), bits).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.groupBy(F.expr(f"cell div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % BITMAP).alias("bits"))


def probe(rows: DataFrame, digest_col: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds ``maybe_repeated``. The broadcast side has at most ``bits`` bits."""
    cell = _cell(F.col(digest_col), bits)
    bitmaps = bitmaps.select(F.col("part").alias("filter_part"), F.col("bits").alias("filter_bits"))
    out = rows.withColumn("row_part", F.floor(cell / BITMAP)).join(F.broadcast(bitmaps), F.col("row_part") == F.col("filter_part"), "left")
    at = (cell % BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring("filter_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8).cast("int"), F.lit(0)) == 1
    return out.withColumn("maybe_repeated", hit).drop("row_part", "filter_part", "filter_bits")


def _groups(digests: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Written ``text_sha256, keep_id, group_size`` of the digests that may be repeated.

    Written, so that both sides of the join to it are shuffled and a large
    group of copies is split over tasks at run time.
    """
    rows = probe(digests, "text_sha256", bitmaps, bits).filter("maybe_repeated")
    return written(rows.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")


def _resolved(rows: DataFrame, groups: DataFrame, bitmaps: DataFrame, bits: int, id_col: str, columns: list[str]) -> DataFrame:
    """``rows`` with their decisions: only those that may be repeated are shuffled."""
    rows, ident = probe(rows, "text_sha256", bitmaps, bits), F.col(id_col)
    shuffled = rows.filter("maybe_repeated").join(groups, "text_sha256").withColumn("kept", ident.eqNullSafe(F.col("keep_id")))
    passed = rows.filter(~F.col("maybe_repeated")).withColumns({"keep_id": ident, "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return shuffled.select(*columns).unionByName(passed.select(*columns))


def _filtered(docs: DataFrame, id_col: str, text_col: str, filter_bits: int | None) -> tuple[DataFrame, DataFrame, int]:
    digests = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    bits = filter_bits or filter_bits_for(digests.count())
    return digests, written(repeat_filter(digests, "text_sha256", bits), "repeats"), bits


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id, group_size, kept, text_sha256`` added."""
    if clash := {*OUT, *HELPERS} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are already there; rename them first")
    digests, bitmaps, bits = _filtered(docs, id_col, text_col, filter_bits)
    rows = docs.withColumn("text_sha256", text_digest(F.col(text_col)))
    return _resolved(rows, _groups(digests, bitmaps, bits), bitmaps, bits, id_col, [*docs.columns, *OUT])


def exact_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One narrow row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    The texts are read once; everything after works on the written digests.
    """
    digests, bitmaps, bits = _filtered(docs, id_col, text_col, filter_bits)
    return _resolved(digests.withColumnRenamed("id", id_col), _groups(digests, bitmaps, bits), bitmaps, bits, id_col, [id_col, *OUT])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names."""
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    return exact_dedup(whole, "id", "text").filter("kept").select("row.*")
