"""Files of a corpus: listing, decoding, hashing, extraction hooks and artifacts.

Mounted folders are walked by ``listing``.  Other stores are listed by
``binaryFile``, which leaves out names that start with ``_`` or ``.``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import sha256
from ..functions.paths import DEFAULT_EXTENSIONS, extension, file_name, in_excluded_dir, is_included, matches_glob
from .charsets import decoded_with_charset
from .listing import hash_files, list_tree


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), excludes: list[str] | None = None, any_extension: bool = False) -> DataFrame:
    """``path, relative_path, file_name, extension, size, mtime`` below a root; contents are not read."""
    if "://" not in root or root.startswith("file://"):
        return list_tree(spark, root, None if any_extension else extensions or DEFAULT_EXTENSIONS, excludes)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.col("path"), f"^.*?{_quoted(base)}/", "")
    out = listed.select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    out = out.withColumns({"file_name": file_name(F.col("relative_path")), "extension": extension(file_name(F.col("relative_path")))})
    if not any_extension:
        out = out.filter(is_included(F.col("extension"), extensions))
    return out.filter(~in_excluded_dir(F.col("relative_path")) & ~matches_glob(F.col("relative_path"), excludes or []))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def hashed_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256`` of every file below a root; in other stores than mounted folders files of up to 2 GB."""
    if "://" not in root or root.startswith("file://"):
        return hash_files(list_tree(spark, root)).select("path", "sha256")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", sha256(F.col("content")).alias("sha256"))


def decoded(content: Column) -> Column:
    """Bytes as text in the charset they seem to be written in; a byte-order mark goes; null where no charset fits."""
    return decoded_with_charset(content)["text"]


def extract(files: DataFrame, extractor: Callable[[], Callable[[str, bytes], list[tuple[int | None, str]]]]) -> DataFrame:
    """``path, index, page_number, text, error`` of ``files(path, content)`` by an extractor made once a task.

    A file that fails gives one row with its error and no text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = extractor()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, number, text, None) for i, (number, text) in enumerate(one(path, content))]
                except Exception as problem:  # noqa: BLE001  one file's failure is not the job's
                    rows.append((path, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["path", "index", "page_number", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, index int, page_number int, text string, error string")


def store_artifacts(artifacts: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Append ``artifacts(address, version, pages)`` that are not stored yet, by version and shard."""
    new = artifacts.dropDuplicates(["address"])
    if stored is not None:
        new = new.join(stored.select("address"), "address", "left_anti")
    # a shard's rows come together, so that a task does not write a file in every shard
    new.withColumn("shard", F.substring(F.sha1("address"), 1, 2)).repartition("version", "shard").write.mode("append").partitionBy("version", "shard").parquet(path)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """``address, index, page_number, text`` of stored artifacts."""
    rows = spark.read.parquet(path).select("address", F.posexplode("pages").alias("index", "p"))
    return rows.select("address", "index", F.col("p.page_number").alias("page_number"), F.col("p.text").alias("text"))
