"""Queries that run streams over the given tables until all there is is done."""

from __future__ import annotations

import contextlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.ids import CHUNK_NAMESPACE, POINT_NAMESPACE, sha256
from ..functions.text import by_parts
from ..operators.chunking import extraction_status
from ..operators.indexing import index_documents, index_files
from ..operators.reports import duplicate_groups
from ..sources.charsets import decoded_in_folders
from ..sources.files import decoded, hashed_files, list_files, load_pages, store_artifacts
from ..sources.keyed import KeyedTable
from ..sources.listing import READ, hash_files, list_tree, local_path
from ..sources.work import rebuild, small_batches, work_path
from ..streaming.jobs import follow_files, ingest, silent_keys, status_counts
from ..streaming.state import changed_files, ended_leases, rocks_state
from .catalog_queries import GROUPS
from .derived import SPARK, spelled
from .registry import ORACLES, QUERIES, query
from .text_queries import INDEXED, INDEXED_SQL, PROFILE, uuid_of


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table (one file, or a folder of files) as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end and return the rows of its last state (complete) or all rows (append)."""
    spark, path = stream.sparkSession, work_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}" if mode == "append" else f"{path}/out/batch=0")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def k1_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "ingest")
    ingest(stream_of(spark, sf_dir, "documents"), index_documents, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").drop("batch")


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    return finished(status_counts(events), "complete")


def silence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"))
    return finished(silent_keys(events, "1 hour"), "append")


def lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended leases of the events in three files that arrive one after the other."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), "event_id", (F.col("event_id") % 10 == 0).alias("cancel"))
    path, cuts = work_path(spark, "beats"), events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    third = (cuts["z"] - cuts["a"]) / 3
    found = f"{path}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{found}/batch={number}")

    for n in range(3):
        own = events.filter((F.col("ts") >= F.lit(cuts["a"] + n * third)) & ((F.col("ts") < F.lit(cuts["a"] + (n + 1) * third)) if n < 2 else F.lit(True)))
        own.write.mode("append").parquet(f"{path}/in")
        with rocks_state(spark):
            ended = ended_leases(spark.readStream.schema(own.schema).parquet(f"{path}/in"), 3600, 4)
            ended.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(found).select("job_id", "event_id", "attempt", "outcome", "expired_at")


QUERIES["k2_lease_stream"] = lease_stream
# what the watermark has not reached is not decided yet
ORACLES["k2_lease_stream"] = """
    WITH b AS (SELECT user_id AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
    x AS (SELECT *, row_number() OVER w AS attempt, lead(ts) OVER w AS next FROM b WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    SELECT job_id, event_id, attempt, CASE WHEN event_id % 10 = 0 THEN 'cancelled' WHEN attempt >= 4 THEN 'failed' ELSE 'retry_wait' END AS outcome, ts + INTERVAL 1 HOUR AS expired_at
    FROM x WHERE (next IS NULL OR next > ts + INTERVAL 1 HOUR) AND ts + INTERVAL 1 HOUR < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM b)"""
#: Scans of the catalog's files: which are there, and which have other bytes.
SCANS = ("k % 3 < 2", "k % 5 <> 1", "k % 7 <> 2")
SCANNED = "SELECT entry_id, location_id, relative_path, CAST(length(text) AS BIGINT) + {n} AS size, mtime, SHA(text || CASE WHEN doc_id % 4 = {n} THEN ' edited' ELSE '' END) AS sha256, TS(1767225600 + {n} * 3600) AS scan_at FROM {{0}} WHERE {where}"


def followed_files(catalog: DataFrame) -> DataFrame:
    """Three scans as a stream, batch after batch, folded into a keyed table that follows them."""
    spark, path = catalog.sparkSession, work_path(catalog.sparkSession, "scans")
    table = None
    for n, where in enumerate(SCANS):
        scan = spark.sql(spelled(SCANNED.format(n=n, where=where), SPARK).format("{t}"), t=catalog).drop("entry_id")
        if table is None:
            table = KeyedTable(spark, f"{path}/files", ("location_id", "relative_path"), ("scan_at",))
            table.create(scan.limit(0))
        scan.write.mode("append").parquet(f"{path}/in")
        follow_files(spark.readStream.schema(scan.schema).parquet(f"{path}/in"), table, f"{path}/state")
    return table.read().select("location_id", "relative_path", "sha256")


# a rebuild from the last scan alone
query("k1_followed_files", "catalog", more=f"s AS ({SCANNED.format(n=2, where=SCANS[2]).format('catalog')})", sql="SELECT location_id, relative_path, sha256 FROM s")(followed_files)


def file_changes(catalog: DataFrame) -> DataFrame:
    """What each of the three scans changed."""
    spark, path = catalog.sparkSession, work_path(catalog.sparkSession, "changes")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{path}/out")

    for n, where in enumerate(SCANS):
        scan = spark.sql(spelled(SCANNED.format(n=n, where=where), SPARK).format("{t}"), t=catalog).drop("entry_id")
        scan.write.mode("append").parquet(f"{path}/in")
        with rocks_state(spark):
            stream = changed_files(spark.readStream.schema(scan.schema).parquet(f"{path}/in"))
            stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("scan_at", "kind", "location_id", "relative_path")


query(
    "k1_file_changes", "catalog",
    more=",\n".join(f"s{n} AS ({SCANNED.format(n=n, where=w).format('catalog')})" for n, w in enumerate(SCANS))
    + """,
    m AS (SELECT TS(1767225600) AS scan_at, location_id, relative_path, NULL AS was, sha256 AS now FROM s0
        UNION ALL SELECT TS(1767229200), coalesce(a.location_id, b.location_id), coalesce(a.relative_path, b.relative_path), a.sha256, b.sha256 FROM s0 a FULL JOIN s1 b ON a.location_id = b.location_id AND a.relative_path = b.relative_path
        UNION ALL SELECT TS(1767232800), coalesce(a.location_id, b.location_id), coalesce(a.relative_path, b.relative_path), a.sha256, b.sha256 FROM s1 a FULL JOIN s2 b ON a.location_id = b.location_id AND a.relative_path = b.relative_path)""",
    sql="SELECT scan_at, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' ELSE 'changed' END AS kind, location_id, relative_path FROM m WHERE was IS DISTINCT FROM now",
)(file_changes)
QUERIES["k1_ingest_stream"] = k1_ingest_stream
QUERIES["k2_silence_stream"] = silence_stream
QUERIES["k3_status_stream"] = status_stream
ORACLES["k3_status_stream"] = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS started, event_type AS status, count(*) AS n FROM events GROUP BY ALL"
QUERIES["s1_corpus_listing"] = lambda spark, sf_dir: list_files(spark, sf_dir, any_extension=True).select("relative_path", "file_name", "extension", "size")
QUERIES["s5_file_hashes"] = lambda spark, sf_dir: hashed_files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "sha256")


def written_files(docs: DataFrame) -> str:
    """All documents as files of one tree, with hidden names, excluded folders, drafts and links; the tree's path."""
    root = work_path(docs.sparkSession, "tree")
    place = local_path(root)
    name = F.expr("concat(element_at(array('_f', '.f', 'f', 'f.'), CAST(doc_id % 4 AS INT) + 1), doc_id, '.', element_at(array('txt', 'MD', 'csv', 'log'), CAST(k % 4 AS INT) + 1))")
    folder = F.expr("concat(location_id, element_at(array('/', '/.d/', '/_e/deep/er/', '/Node_Modules/', '/drafts/'), CAST(doc_id % 5 AS INT) + 1))")

    @F.arrow_udf("long")
    def write(paths: pa.Array, texts: pa.Array, ids: pa.Array) -> pa.Array:
        for path, text, i in zip(paths.to_pylist(), texts.to_pylist(), ids.to_pylist(), strict=True):
            full = f"{place}/{path}"
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(text.encode())
            os.utime(full, (1735689600 + i * 60,) * 2)
            if i % 13 == 0:  # a task that runs again finds its links
                with contextlib.suppress(FileExistsError):
                    os.symlink(full, f"{full[:-4]}-link.txt")
                with contextlib.suppress(FileExistsError):
                    os.symlink(os.path.dirname(full), f"{place}/link-{i}")
        return pa.array([1] * len(paths), pa.int64())

    docs.select(write(F.concat(folder, name), F.col("text"), F.col("doc_id")).alias("n")).agg(F.sum("n")).collect()
    return root


def walked_tree(docs: DataFrame) -> DataFrame:
    """Path, size, time and hash of the documents' files that the rules let through."""
    listed = list_files(docs.sparkSession, written_files(docs), ("txt", "md", "csv"), excludes=["*/drafts", "src7/*"])
    return hash_files(listed).select("relative_path", "file_name", "extension", "size", "mtime", "sha256")


query(
    "s1_s5_walked_tree", "docs",
    more="""f AS (SELECT location_id || ['/', '/.d/', '/_e/deep/er/', '/Node_Modules/', '/drafts/'][doc_id % 5 + 1] || ['_f', '.f', 'f', 'f.'][doc_id % 4 + 1] || doc_id || '.' || ['txt', 'MD', 'csv', 'log'][k % 4 + 1] AS relative_path, ['txt', 'md', 'csv', 'log'][k % 4 + 1] AS extension, doc_id, text
        FROM docs WHERE doc_id % 5 < 3 AND k % 4 < 3 AND location_id <> 'src7')""",
    sql="SELECT relative_path, list_last(string_split(relative_path, '/')) AS file_name, extension, CAST(strlen(text) AS BIGINT) AS size, TS(1735689600 + doc_id * 60) AS mtime, sha256(text) AS sha256 FROM f",
)(walked_tree)


def hashed_large(docs: DataFrame) -> DataFrame:
    """Hashes of the documents' files, each fiftieth made larger than what is read at once."""
    large = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.repeat("text", F.lit(1) + F.floor(F.lit(2 * READ) / F.greatest(F.lit(1), F.octet_length("text"))).cast("int"))).otherwise(F.col("text")))
    root = written_files(large.filter("doc_id % 50 = 0 OR doc_id % 50 = 1"))
    return hash_files(list_tree(docs.sparkSession, root)).select("file_name", "size", "sha256")


query(
    "s5_large_files", "docs",
    more=f"""f AS (SELECT ['_f', '.f', 'f', 'f.'][doc_id % 4 + 1] || doc_id || '.' || ['txt', 'MD', 'csv', 'log'][k % 4 + 1] AS file_name, CASE WHEN doc_id % 50 = 0 THEN repeat(text, CAST(1 + floor({2 * READ} / greatest(1, strlen(text))) AS BIGINT)) ELSE text END AS text
        FROM docs WHERE doc_id % 50 IN (0, 1) AND doc_id % 5 <> 3)""",
    sql="SELECT file_name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM f",
)(hashed_large)


def listed_corpus(docs: DataFrame) -> DataFrame:
    """All documents written as text files of their locations, then listed: folders with the bytes of their files (marker files have no such extension)."""
    path = work_path(docs.sparkSession, "corpus")
    docs.select("location_id", F.translate("text", "\r\n", "  ").alias("value")).write.partitionBy("location_id").text(path)
    listed = list_files(docs.sparkSession, path, extensions=("txt",))
    return listed.groupBy(F.regexp_extract("relative_path", "^location_id=([^/]+)/", 1).alias("location_id"), "extension").agg(F.sum("size").alias("bytes"))


query("s1_listed_corpus", "docs", sql="SELECT location_id, 'txt' AS extension, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM docs GROUP BY location_id")(listed_corpus)
query("r9_index_pipeline", "documents", more=INDEXED, sql=INDEXED_SQL)(index_documents)
# one batch reads all there is, so the stream has the rows of the batch job
ORACLES["k1_ingest_stream"] = f"WITH RECURSIVE {INDEXED} {INDEXED_SQL}"
ORACLES["k2_silence_stream"] = """
    WITH b AS (SELECT user_id AS job_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
    l AS (SELECT job_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM b),
    s AS (SELECT job_id, ts, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS expired_at, count(*) AS beats FROM s GROUP BY job_id, n
    HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM b)"""


def bytes_of(text: str) -> str:
    """A text's bytes as UTF-8, as UTF-16 with its mark, or as UTF-8 with a mark, by turns."""
    return f"CASE k % 3 WHEN 0 THEN encode({text}, 'UTF-8') WHEN 1 THEN concat(X'FFFE', encode({text}, 'UTF-16LE')) ELSE concat(X'EFBBBF', encode({text}, 'UTF-8')) END"


query("s14_decoded_text", "docs", sql="SELECT doc_id, length(text) AS chars, sha256(text) AS text_sha256 FROM docs")(
    lambda d: d.select("doc_id", decoded(F.expr(bytes_of("text"))).alias("t")).select("doc_id", F.length("t").cast("long").alias("chars"), sha256(F.col("t")).alias("text_sha256"))
)


#: Letters that stand for a text's own in other scripts, by charset.
LETTERS = "abcdefghijklmnopqrstuvwxyzéèçêóñíäöüß"
SCRIPTS = {
    "cyrillic": "адмдеглвийклсноккрстувшхыземжпуьёябцч",
    "greek": "αβγδεφγηιθκλμνοπψρστυωχξζάέήίόύώϊϋηθι",
    "kana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも",
    "polish": "abćdefgłijklmnopąrstuvłxyżęąćłóńśźżłś",
}
CHARSETS = {
    "utf-8": None, "utf-16-le": None, "utf-16-be": None, "cp1252": None, "iso8859_2": "polish", "cp1251": "cyrillic", "koi8_r": "cyrillic",
    "shift_jis": "kana", "iso8859_7": "greek", "euc_jp": "kana",
}


def written_in(script: str | None) -> str:
    """A text in another script, as SQL of both engines."""
    return f"translate(lower(text), '{LETTERS}', '{SCRIPTS[script]}')" if script else "text"


@F.arrow_udf(BinaryType())
def encoded(texts: pa.Array, charsets: pa.Array) -> pa.Array:
    """Bytes in a charset; in UTF-8 where the text does not fit it, or has fewer than 8 letters that could tell it."""

    def one(text: str, charset: str) -> bytes:
        if not charset.startswith("utf") and len(text) - len(text.encode("ascii", "ignore")) < 8:
            return text.encode()
        try:
            return text.encode(charset)
        except UnicodeEncodeError:
            return text.encode()

    both = pa.StructArray.from_arrays([texts, charsets], ["text", "charset"])
    return by_parts(both, lambda part: pa.array([one(x["text"], x["charset"]) for x in part.to_pylist()], pa.binary()))


def in_ten_charsets(docs: DataFrame) -> DataFrame:
    """All documents as bytes in ten charsets by turns, a folder for each, as text again."""
    turn = F.pmod(F.col("doc_id"), F.lit(len(CHARSETS))).cast("int")
    text, charset = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, script) in enumerate(CHARSETS.items()):
        text, charset = F.when(turn == i, F.expr(written_in(script))).otherwise(text), F.when(turn == i, name).otherwise(charset)
    content = docs.select("doc_id", turn.alias("folder"), encoded(text, charset).alias("content"))
    # files have bytes: what is decoded is read from a table of them
    path = work_path(docs.sparkSession, "encoded")
    with small_batches(docs.sparkSession):
        content.write.parquet(path)
    back = docs.sparkSession.read.parquet(path)
    read = decoded_in_folders(back, "folder").withColumnRenamed("text", "t")
    return read.select("doc_id", F.length("t").cast("long").alias("chars"), sha256(F.col("t")).alias("text_sha256"), extraction_status(F.lit("txt"), F.col("content"), F.col("t")).alias("status"))


query(
    "s13_s14_ten_charsets", "docs",
    sql="SELECT doc_id, length(t) AS chars, sha256(t) AS text_sha256, CASE WHEN t = '' THEN 'empty_file' WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' THEN 'no_extractable_text' ELSE 'ok' END AS status FROM (SELECT doc_id, CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN {written_in(s)}" for i, s in enumerate(CHARSETS.values()))
    + " END AS t FROM docs) x",
)(in_ten_charsets)


def artifact_pages(docs: DataFrame) -> DataFrame:
    """Artifacts of all documents stored, then stored again in vain, then read back to pages."""
    path = work_path(docs.sparkSession, "artifacts")
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))
    own = docs.select(F.concat(F.lit("v1/"), F.col("doc_id").cast("string")).alias("address"), F.lit("v1").alias("version"), pages.alias("pages"))
    store_artifacts(own, path)
    store_artifacts(own, path, docs.sparkSession.read.parquet(path))
    return load_pages(docs.sparkSession, path)


query("s17_artifact_pages", "docs", sql="SELECT 'v1/' || doc_id AS address, CAST(i - 1 AS INTEGER) AS index, CAST(i AS INTEGER) AS page_number, a[i] AS text FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs) x) y")(artifact_pages)


def rebuilt(members: DataFrame) -> DataFrame:
    """The duplicate report built over an earlier state of itself."""
    path = work_path(members.sparkSession, "report")
    rebuild(duplicate_groups(members.filter("location_id = 'src1'")), path)
    rebuild(duplicate_groups(members), path)
    return members.sparkSession.read.parquet(path)


query("s20_rebuilt_report", "members", more=GROUPS, sql="SELECT * FROM g")(rebuilt)


def verified_points(docs: DataFrame) -> DataFrame:
    """Points of all files but those whose bytes have changed since they were observed; every third content is stored already."""
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f_"), F.col("k").cast("string"), F.lit(".txt")).alias("name"), F.expr(bytes_of("text")).alias("content"), "k")
    files = files.withColumn("sha256", F.when(F.col("k") % 7 == 3, "changed").otherwise(sha256(F.col("content")))).drop("k")
    path = work_path(docs.sparkSession, "stored")
    index_documents(docs.filter("k % 7 <> 3")).select("content_id").write.parquet(path)
    stored = docs.sparkSession.read.parquet(path).filter("conv(substr(content_id, 1, 4), 16, 10) % 3 = 0").select("content_id", F.lit(PROFILE).alias("chunking_profile"), F.lit("e1").alias("embedding_profile"))
    return index_files(files, stored, "e1").select("content_id", "chunk_id", "point_id", "chunk_index", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("slots"))


DUE = INDEXED.replace("FROM documents WHERE text IS NOT NULL", "FROM docs WHERE k % 7 <> 3").replace("bodies AS (SELECT doc_id,", "bodies AS (SELECT doc_id, k,").replace("min(doc_id) AS doc_id,", "arg_min(k, doc_id) AS k,")
query(
    "r9_verified_points", "docs",
    more=DUE + r""",
    w AS (SELECT content_id, chunk_index, unnest(list_distinct(regexp_extract_all(lower('[File: f ' || k || ' txt]' || chr(10) || cs.text), '[\p{L}\p{N}]{2,}'))) AS t FROM cs JOIN contents USING (content_id)),
    slots AS (SELECT content_id, chunk_index, count(DISTINCT CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) % 8) AS slots FROM w GROUP BY ALL)""",
    sql=f"""SELECT content_id, {uuid_of(CHUNK_NAMESPACE, f"content_id || ':{PROFILE}:' || chunk_index")} AS chunk_id, {uuid_of(POINT_NAMESPACE, f"content_id || ':{PROFILE}:e1:' || chunk_index")} AS point_id, chunk_index, slots
        FROM cs JOIN slots USING (content_id, chunk_index) WHERE CAST('0x' || substr(content_id, 1, 4) AS INTEGER) % 3 <> 0""",
)(verified_points)
