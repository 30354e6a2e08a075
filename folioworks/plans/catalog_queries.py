"""Queries over the catalog: scans, views, filters, reconciling, comparing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, paths, times
from ..functions.text import contains_ignoring_case, escape_like
from ..operators import catalog as c
from ..operators import reconcile as r
from ..operators import reports as rep
from ..sources.keyed import KeyedTable
from ..sources.paged import PagedTable
from ..sources.work import work_path
from .registry import query

SQL_NOW = "TIMESTAMP '2026-01-01 12:00:00'"
VERSIONS = "SELECT entry_id, entry_id AS version_id, content_id, CASE WHEN error_code IS NOT NULL THEN 'failed' ELSE 'extracted' END AS status, error_code, sha256 FROM catalog"


def now():
    return F.lit("2026-01-01 12:00:00").cast("timestamp")


# scans and sources

query("s2_included_extensions", "catalog", sql="SELECT entry_id, relative_path FROM catalog WHERE extension IN ('pdf', 'txt', 'md', 'csv', 'docx')")(
    lambda t: t.filter(paths.is_included(F.col("extension"))).select("entry_id", "relative_path")
)
DIRS = "SELECT entry_id, CASE k % 4 WHEN 0 THEN 'a/.Git/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'git/' ELSE '' END || relative_path AS p FROM catalog"
query("s3_excluded_dirs", "catalog", more=f"x AS ({DIRS})", sql="SELECT entry_id, p FROM x WHERE NOT regexp_matches(lower(p), '(^|/)(\\.git|node_modules)/')")(
    lambda t: t.selectExpr("entry_id", "CASE k % 4 WHEN 0 THEN 'a/.Git/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'git/' ELSE '' END || relative_path AS p").filter(~paths.in_excluded_dir(F.col("p")))
)
query("s4_exclusion_globs", "catalog", sql="SELECT entry_id, relative_path FROM catalog WHERE NOT (relative_path GLOB '*.log' OR split_part(relative_path, '/', 1) GLOB 'd[2-3]' OR relative_path GLOB 'twin*f1?.*')")(
    lambda t: t.filter(~paths.matches_glob(F.col("relative_path"), ["*.log", "d[2-3]", "twin*f1?.*"])).select("entry_id", "relative_path")
)
query("s5_content_hash", "docs", sql="SELECT doc_id, sha256(text) AS sha256 FROM docs")(lambda t: t.select("doc_id", ids.sha256(F.col("text")).alias("sha256")))
query(
    "s6_hash_carry_forward", "catalog", "observed",
    sql="SELECT o.location_id, o.relative_path, CASE WHEN c.size = o.size AND c.mtime = o.mtime THEN c.sha256 END AS carried, CASE WHEN c.size = o.size AND c.mtime = o.mtime THEN c.sha256 ELSE o.sha256 END AS sha256 FROM observed o LEFT JOIN catalog c USING (location_id, relative_path)",
)(lambda cat, obs: c.carried_hashes(obs, cat).select("location_id", "relative_path", "carried", F.coalesce("carried", "sha256").alias("sha256")))
query("s7_prior_snapshot", "catalog", sql="SELECT relative_path, size, mtime, sha256 FROM catalog WHERE location_id = 'src3'")(
    lambda t: t.filter("location_id = 'src3'").select("relative_path", "size", "mtime", "sha256")
)
query(
    "s8_s9_scan_guard", "locations", "sentinels",
    sql="SELECT location_id, coalesce(sentinel_id, observed_sentinel) AS sentinel_id FROM locations JOIN sentinels USING (location_id) WHERE observed_sentinel IS NOT NULL AND (sentinel_id IS NULL OR sentinel_id = observed_sentinel)",
)(lambda loc, seen: c.scan_ready(loc, seen).select("location_id", "sentinel_id"))
query(
    "s12_s13_extraction_status", "catalog",
    sql="SELECT entry_id, CASE WHEN extension NOT IN ('txt', 'md', 'csv') THEN 'unsupported_type' WHEN text = '' THEN 'empty_file' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'no_extractable_text' ELSE 'ok' END AS status FROM catalog",
)(lambda t: t.select("entry_id", c_status().alias("status")))


def c_status():
    from ..operators.chunking import extraction_status

    return extraction_status(F.col("extension"), F.col("text"))


query("s15_reread_guard", "catalog", "observed", sql="SELECT c.entry_id, c.sha256 = o.sha256 AS publish FROM catalog c JOIN observed o USING (location_id, relative_path)")(
    lambda cat, obs: cat.select("entry_id", "location_id", "relative_path", ids.sha256(F.col("text")).alias("now")).join(obs, ["location_id", "relative_path"]).select("entry_id", (F.col("now") == F.col("sha256")).alias("publish"))
)
CHUNKS = "SELECT entry_id, content_id, 1 AS version, TIMESTAMP '2025-01-01 00:00:00' AS updated_at FROM catalog WHERE content_id IS NOT NULL AND k % 3 < 2"
NEW_CHUNKS = "SELECT entry_id, content_id, 2 AS version, TIMESTAMP '2025-01-02 00:00:00' AS updated_at FROM catalog WHERE content_id IS NOT NULL AND k % 3 > 0"
query(
    "s18_s19_upsert", "catalog", more=f"a AS ({CHUNKS}), b AS ({NEW_CHUNKS})",
    sql=f"SELECT * FROM a WHERE entry_id NOT IN (SELECT entry_id FROM b) UNION ALL SELECT entry_id, content_id, version, {SQL_NOW} FROM b",
)(
    lambda t: c.upsert(
        t.filter("content_id IS NOT NULL AND k % 3 < 2").select("entry_id", "content_id", F.lit(1).alias("version"), F.lit("2025-01-01").cast("timestamp").alias("updated_at")),
        t.filter("content_id IS NOT NULL AND k % 3 > 0").select("entry_id", "content_id", F.lit(2).alias("version")), ["entry_id"], now(),
    )
)
def bucketed_upsert(t):
    """A stored table whose keys get three changes each, out of order, and some a deletion; applied twice."""
    own = t.filter("content_id IS NOT NULL").select("entry_id", "content_id", "k")
    table = KeyedTable(t.sparkSession, work_path(t.sparkSession, "chunks"), ("entry_id",), ("version",))
    table.create(own.filter("k % 3 < 2").select("entry_id", "content_id", F.lit(0).alias("version")))
    changes = own.filter("k % 3 > 0 AND k % 20 < 5").withColumn("version", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))))
    for _ in range(2):
        table.change(changes.select("entry_id", "content_id", "version", (F.col("k") % 20 == 4).alias("gone")), deleted="gone")
    return table.read().select("entry_id", "content_id", "version")


query(
    "s18_s20_keyed_table", "catalog",
    sql="SELECT entry_id, content_id, CASE WHEN k % 3 > 0 AND k % 20 < 5 THEN 3 ELSE 0 END AS version FROM catalog WHERE content_id IS NOT NULL AND (k % 3 < 2 OR k % 20 < 5) AND NOT (k % 3 > 0 AND k % 20 = 4)",
)(bucketed_upsert)
query("s21_delete_content", "points", sql="SELECT point_id FROM points WHERE doc_id % 5 <> 0")(
    lambda t: c.without(t, t.filter("doc_id % 5 = 0"), ["content_id"]).select("point_id")
)
query("s22_geometry", "points", sql="SELECT point_id, len(vector) = 64 AND doc_id % 3 <> 0 AS accepted FROM points")(
    lambda t: c.fit_geometry(t.withColumn("distance", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'dot' ELSE 'cosine' END")), 64, "cosine").select("point_id", "accepted")
)
query("s23_points_of_content", "points", sql="SELECT point_id FROM points WHERE content_id IN ('c1', 'c2', 'c3')")(lambda t: t.filter(F.col("content_id").isin("c1", "c2", "c3")).select("point_id"))
query(
    "s24_checksums", "catalog", "observed",
    sql="SELECT count(o.sha256) AS checked, count(*) FILTER (WHERE o.sha256 <> c.sha256) AS mismatched, count(*) FILTER (WHERE o.sha256 IS NULL) AS missing, count(*) FILTER (WHERE o.sha256 IS NULL OR o.sha256 <> c.sha256) = 0 AS ok FROM catalog c LEFT JOIN observed o USING (location_id, relative_path)",
)(lambda cat, obs: rep.verify_sums(*[t.select(F.concat_ws("/", "location_id", "relative_path").alias("path"), "sha256") for t in (cat, obs)]))
query(
    "s16_s25_artifact_inventory", "catalog",
    sql="SELECT address, h AS sha256, CASE WHEN h IS NULL THEN 'missing_artifact' END AS warning FROM (SELECT DISTINCT 'v1/' || substr(sha256, 1, 2) || '/' || sha256 AS address, CASE WHEN substr(sha256, 3, 1) < 'c' THEN sha256 END AS h FROM catalog WHERE content_id IS NOT NULL) x",
)(
    lambda t: rep.artifact_inventory(
        t.filter("content_id IS NOT NULL").select(address().alias("address")), t.filter("content_id IS NOT NULL AND substr(sha256, 3, 1) < 'c'").select(address().alias("address"), "sha256").distinct()
    )
)


def address():
    return F.concat(F.lit("v1/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"))


# projections and filters

VERSION = "SELECT entry_id AS version_id, content_id, CASE WHEN error_code IS NOT NULL THEN 'failed' ELSE 'extracted' END AS status, error_code, CAST(NULL AS STRING) AS error_message FROM {t}"
CONTENT = "SELECT content_id, CAST(max(length(text)) AS BIGINT) AS character_count, CAST(1 AS BIGINT) AS page_count FROM {t} WHERE content_id IS NOT NULL GROUP BY content_id"


def parts(cat):
    """Entries, versions and contents of the catalog as tables of their own."""
    spark = cat.sparkSession
    entries = cat.select("entry_id", F.col("entry_id").alias("version_id"), "location_id", "relative_path", "extension", "state", "created_at", "k")
    return entries, spark.sql(VERSION, t=cat), spark.sql(CONTENT, t=cat)


def view(cat, loc):
    entries, versions, contents = parts(cat)
    return c.document_view(entries, loc, versions, contents)


VIEW = "v AS (SELECT c.entry_id, c.location_id, l.name, c.relative_path, c.state, c.error_code, c.content_id, c.k, c.extension, c.created_at, CASE WHEN c.content_id IS NOT NULL THEN c.size END AS character_count FROM catalog c JOIN locations l USING (location_id))"
query("p1_j1_document_view", "catalog", "locations", more=VIEW, sql="SELECT entry_id, name, relative_path, state, error_code, coalesce(error_code || '', '') AS error, content_id, character_count FROM v")(
    lambda cat, loc: view(cat, loc).select("entry_id", "name", "relative_path", "state", "error_code", F.coalesce(F.col("error.code"), F.lit("")).alias("error"), "content_id", F.col("content.character_count").alias("character_count"))
)
query("p2_location_projection", "locations", sql="SELECT location_id, name, path_style, display_root, enabled, policy, interval_minutes FROM locations")(
    lambda t: t.select("location_id", "name", "path_style", "display_root", "enabled", "policy", "interval_minutes")
)
query(
    "p3_job_projection", "catalog",
    sql="SELECT entry_id, CASE WHEN k % 2 = 0 THEN 'source_location' WHEN k % 3 = 0 THEN 'catalog_entry' END AS target_type, CASE WHEN k % 2 = 0 THEN location_id WHEN k % 3 = 0 THEN entry_id END AS target_id, CASE WHEN error_code IS NOT NULL THEN k % 3 < 2 END AS retryable FROM catalog",
)(
    lambda t: c.job_projection(
        t.selectExpr("entry_id AS job", "CASE WHEN k % 2 = 0 THEN location_id END AS location_id", "CASE WHEN k % 3 = 0 THEN entry_id END AS entry_id", "error_code", "element_at(array('transient', 'internal_unclassified', 'permanent'), CAST(k % 3 + 1 AS INT)) AS error_class")
    ).select(F.col("job").alias("entry_id"), "target_type", "target_id", "retryable")
)
query("p5_multi_value_filters", "catalog", sql="SELECT entry_id FROM catalog WHERE state IN ('indexed', 'failed') AND extension IN ('md', 'csv')")(
    lambda t: t.filter(c.any_of(state=["indexed", "failed"], extension=["md", "csv"], location_id=[])).select("entry_id")
)
query("p6_substring_search", "catalog", sql=r"SELECT entry_id FROM catalog WHERE relative_path ILIKE '%F1\_%' ESCAPE '\' OR relative_path ILIKE '%TWIN/F2%' OR entry_id ILIKE '%E7%'")(
    lambda t: t.filter(contains_ignoring_case(F.col("relative_path"), "F1_") | contains_ignoring_case(F.col("relative_path"), "TWIN/F2") | contains_ignoring_case(F.col("entry_id"), "E7")).select("entry_id")
)
query("p7_error_queue", "catalog", sql="SELECT entry_id, error_code FROM catalog WHERE state = 'failed' AND error_code IS NOT NULL")(
    lambda t: c.error_queue(parts(t)[0], parts(t)[1]).select("entry_id", "error_code")
)
query("p8_keyset", "catalog", sql="SELECT entry_id FROM catalog WHERE relative_path < 'd3/f20.txt' OR (relative_path = 'd3/f20.txt' AND entry_id > 'e5')")(
    lambda t: t.filter(c.keyset("relative_path", "entry_id", "d3/f20.txt", "e5", descending=True)).select("entry_id")
)
query("p9_job_filters", "jobs", sql="SELECT event_id FROM jobs WHERE status IN ('failed', 'running') AND phase IN ('click', 'view', 'purchase')")(
    lambda t: t.filter(c.any_of(status=["failed", "running"], phase=["click", "view", "purchase"])).select("event_id")
)
REINDEX = "state IN ('indexed', 'failed', 'unsupported')"
query("p14_reindexable", "catalog", sql=f"SELECT entry_id FROM catalog WHERE {REINDEX} AND location_id = 'src4'")(lambda t: c.reindexable(t, "src4").select("entry_id"))
query("p15_index_worklist", "catalog", sql="SELECT DISTINCT entry_id, false AS forced FROM catalog WHERE state = 'discovered' AND k % 5 <> 2")(
    lambda t: c.index_worklist(t, t.filter("k % 5 = 2").select("entry_id"))
)
query("r10_reindex_worklist", "catalog", sql=f"SELECT DISTINCT entry_id, true AS forced FROM catalog WHERE {REINDEX} AND k % 5 <> 2")(lambda t: c.reindex_worklist(t, t.filter("k % 5 = 2").select("entry_id")))
query(
    "p16_due_locations", "locations",
    sql=f"SELECT location_id FROM locations WHERE enabled AND interval_minutes IS NOT NULL AND (last_scan IS NULL OR last_scan + to_minutes(CAST(interval_minutes AS INTEGER)) <= TIMESTAMP '2026-01-01 01:30:00')",
)(lambda t: c.due_locations(t.withColumn("interval_minutes", F.col("interval_minutes").cast("int")), F.lit("2026-01-01 01:30:00").cast("timestamp")).select("location_id"))
J = "j AS (SELECT event_id AS job_id, status, ts FROM jobs)"
query("p17_stale_staging", "jobs", more=J + ", cut AS (SELECT max(ts) AS now FROM jobs)", sql="SELECT job_id FROM j, cut WHERE ts < now - INTERVAL 24 HOUR AND status IN ('succeeded', 'failed', 'cancelled')")(
    lambda t: c.stale_staging(t.select(F.col("event_id").alias("job_id"), F.col("ts").alias("staged_at")).crossJoin(F.broadcast(t.agg(F.max("ts").alias("now")))), t.select(F.col("event_id").alias("job_id"), "status"), F.col("now")).select("job_id")
)
query("p17_stale_keys", "jobs", more=J + ", cut AS (SELECT max(ts) AS now FROM jobs)", sql="SELECT CASE WHEN job_id % 7 <> 0 THEN job_id END AS job_id FROM j, cut WHERE ts < now - INTERVAL 24 HOUR AND (job_id % 7 = 0 OR status IN ('succeeded', 'failed', 'cancelled'))")(
    lambda t: c.stale_keys(t.selectExpr("CASE WHEN event_id % 7 <> 0 THEN event_id END AS job_id", "ts AS created_at").crossJoin(F.broadcast(t.agg(F.max("ts").alias("now")))), t.select(F.col("event_id").alias("job_id"), "status"), F.col("now")).select("job_id")
)
query("p18_path_style", "locations", sql="SELECT location_id, CASE num % 4 WHEN 0 THEN 'linux' WHEN 2 THEN 'unc' ELSE 'mapped_drive' END AS style FROM locations")(
    lambda t: t.select("location_id", paths.path_style(F.col("display_root")).alias("style"))
)
query(
    "p19_root_validation", "locations",
    sql="SELECT location_id, CASE WHEN num % 10 = 9 THEN 'not_absolute' WHEN num % 4 = 3 THEN 'not_allowed' END AS problem FROM locations",
)(
    lambda t: t.select("location_id", paths.root_problem(F.when(F.col("num") % 10 == 9, F.concat("display_root", F.when(paths.is_windows(F.col("path_style")), "\\..\\x").otherwise("../x"))).otherwise(F.col("display_root")), F.col("path_style"), [("/data", "linux"), ("C:\\docs", "windows"), ("\\\\server\\share", "unc")]).alias("problem"))
)
query(
    "p21_redaction", "catalog",
    sql="SELECT entry_id, '***redacted***' AS token, location_id AS note, '***redacted***' AS answer FROM catalog",
)(
    lambda t: t.select("entry_id", c.redacted(F.create_map(F.lit("Token"), "sha256", F.lit("note"), "location_id", F.lit("ANSWER"), "relative_path")).alias("m")).select("entry_id", F.col("m")["Token"].alias("token"), F.col("m")["note"].alias("note"), F.col("m")["ANSWER"].alias("answer"))
)
query("f14_like_escape", "catalog", sql=r"SELECT entry_id, replace(replace(replace(x, '\', '\\'), '%', '\%'), '_', '\_') AS e FROM (SELECT entry_id, relative_path || '%_' || chr(92) || state AS x FROM catalog) y")(
    lambda t: t.select("entry_id", escape_like(F.concat("relative_path", F.lit("%_\\"), "state")).alias("e"))
)

# joins, reconciling, comparing

query("j2_indexed_members", "catalog", "locations", sql="SELECT entry_id, location_id, content_id FROM catalog WHERE state = 'indexed' AND content_id IS NOT NULL")(
    lambda cat, loc: c.indexed_members(parts(cat)[0], loc, parts(cat)[1], parts(cat)[2]).select("entry_id", "location_id", "content_id")
)
query("j3_location_snapshot", "catalog", "locations", sql="SELECT entry_id, content_id FROM catalog WHERE state = 'indexed' AND content_id IS NOT NULL AND location_id = 'src2'")(
    lambda cat, loc: c.indexed_members(parts(cat)[0], loc, parts(cat)[1], parts(cat)[2]).filter("location_id = 'src2'").select("entry_id", "content_id")
)
RECONCILE = """
    b AS (SELECT coalesce(c.location_id, o.location_id) AS location_id, coalesce(c.relative_path, o.relative_path) AS relative_path, c.entry_id, c.state, c.sha256 AS old_sha, c.size AS old_size, c.mtime AS old_mtime,
            o.sha256, o.size, o.mtime, c.entry_id IS NOT NULL AS known, o.sha256 IS NOT NULL AS seen
        FROM catalog c FULL JOIN observed o ON c.location_id = o.location_id AND c.relative_path = o.relative_path),
    gone AS (SELECT *, row_number() OVER (PARTITION BY location_id, old_sha ORDER BY relative_path DESC) AS turn FROM b WHERE known AND NOT seen),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY location_id, sha256 ORDER BY relative_path) AS turn FROM b WHERE NOT known),
    moved AS (SELECT g.entry_id, f.location_id, f.relative_path, g.state = 'missing' AS was, CASE WHEN g.state = 'missing' THEN 'discovered' ELSE g.state END AS state FROM fresh f JOIN gone g ON f.location_id = g.location_id AND f.sha256 = g.old_sha AND f.turn = g.turn),
    met AS (SELECT *, CASE WHEN state = 'missing' THEN 'restored' WHEN old_sha <> sha256 THEN 'changed' WHEN old_size = size AND old_mtime = mtime THEN 'unchanged' ELSE 'metadata' END AS kind FROM b WHERE known AND seen),
    plan AS (
        SELECT kind, entry_id, location_id, relative_path, CASE WHEN kind IN ('restored', 'changed') THEN 'discovered' ELSE state END AS state, kind = 'restored' AS clear_missing FROM met
        UNION ALL SELECT 'moved', entry_id, location_id, relative_path, state, was FROM moved
        UNION ALL SELECT 'added', NULL, location_id, relative_path, 'discovered', false FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.location_id = f.location_id AND m.relative_path = f.relative_path)
        UNION ALL SELECT 'missing', entry_id, location_id, relative_path, 'missing', false FROM gone g WHERE state <> 'missing' AND entry_id NOT IN (SELECT entry_id FROM moved))"""
PLAN = ["kind", "entry_id", "location_id", "relative_path", "state", "clear_missing"]
query("j4_j5_reconcile", "catalog", "observed", more=RECONCILE, sql="SELECT * FROM plan")(lambda cat, obs: r.reconcile(cat, obs).select(*PLAN))
query("a6_reconcile_tallies", "catalog", "observed", more=RECONCILE, sql="SELECT kind, count(*) AS n FROM plan GROUP BY kind")(lambda cat, obs: r.tallies(r.reconcile(cat, obs)))
query(
    "j6_u4_apply_plan", "catalog", "observed", more=RECONCILE,
    sql=f"""SELECT entry_id, location_id, relative_path, state, missing_at FROM catalog WHERE entry_id NOT IN (SELECT entry_id FROM plan WHERE entry_id IS NOT NULL)
        UNION ALL SELECT coalesce(p.entry_id, 'n:' || p.location_id || ':' || p.relative_path), p.location_id, p.relative_path, p.state, CASE WHEN p.kind = 'missing' THEN {SQL_NOW} WHEN p.clear_missing OR p.kind = 'added' THEN NULL ELSE c.missing_at END
        FROM plan p LEFT JOIN catalog c ON c.entry_id = p.entry_id""",
)(lambda cat, obs: r.apply_plan(cat, r.reconcile(cat, obs), now(), F.concat_ws(":", F.lit("n"), "location_id", "relative_path")).select("entry_id", "location_id", "relative_path", "state", "missing_at"))
COMPARE = """
    sha AS (SELECT location_id, sha256, min(relative_path) AS p FROM mirror GROUP BY ALL),
    txt AS (SELECT location_id, text_hash, min(relative_path) AS p, arg_min(sha256, relative_path) AS h FROM mirror GROUP BY ALL),
    items AS (SELECT c.entry_id, c.location_id, CASE WHEN m.sha256 = c.sha256 THEN 'already_present' WHEN m.sha256 IS NOT NULL THEN 'conflict' WHEN s.p IS NOT NULL OR t.p IS NOT NULL THEN 'manual_review' ELSE 'copy' END AS action,
            CASE WHEN m.sha256 = c.sha256 THEN 'exact' WHEN m.sha256 IS NOT NULL THEN 'path_conflict' WHEN s.p IS NOT NULL THEN 'renamed' WHEN t.p IS NOT NULL THEN 'text_equivalent' ELSE 'missing' END AS reason,
            CASE WHEN m.sha256 IS NOT NULL THEN c.relative_path ELSE coalesce(s.p, t.p) END AS target_path,
            CASE WHEN m.sha256 IS NOT NULL THEN m.sha256 WHEN s.p IS NOT NULL THEN c.sha256 ELSE t.h END AS target_sha256
        FROM catalog c LEFT JOIN mirror m ON m.location_id = c.location_id AND m.relative_path = c.relative_path
        LEFT JOIN sha s ON s.location_id = c.location_id AND s.sha256 = c.sha256 LEFT JOIN txt t ON t.location_id = c.location_id AND t.text_hash = c.text_hash)"""
query("j7_r11_compare_locations", "catalog", "mirror", more=COMPARE, sql="SELECT * FROM items")(
    lambda cat, mir: rep.compare_locations(cat, mir).select("entry_id", "location_id", "action", "reason", "target_path", "target_sha256")
)
query("p10_plan_items", "catalog", "mirror", more=COMPARE, sql="SELECT entry_id, reason FROM items WHERE action IN ('conflict', 'copy')")(
    lambda cat, mir: rep.compare_locations(cat, mir).filter(c.any_of(action=["conflict", "copy"])).select("entry_id", "reason")
)
query(
    "a5_comparison_summary", "catalog", "mirror", more=COMPARE,
    sql="SELECT *, CASE WHEN total > 0 THEN round_even(covered * 100.0 / total, 1) ELSE 0 END::DOUBLE AS covered_percent FROM (SELECT location_id, count(*) AS total, count(*) FILTER (WHERE action = 'already_present') AS present, count(*) FILTER (WHERE action = 'manual_review') AS review, count(*) FILTER (WHERE action = 'conflict') AS conflict, count(*) FILTER (WHERE action = 'copy') AS to_copy, count(*) FILTER (WHERE action IN ('already_present', 'manual_review')) AS covered FROM items GROUP BY location_id) x",
)(lambda cat, mir: rep.comparison_summary(rep.compare_locations(cat, mir)))
query("j8_orphan_contents", "catalog", sql="SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL AND content_id NOT IN (SELECT content_id FROM catalog WHERE state = 'indexed' AND content_id IS NOT NULL)")(
    lambda t: rep.orphan_contents(t.filter("content_id IS NOT NULL").select("content_id").distinct(), t)
)
query("j9_superseded_collections", "catalog", sql="SELECT DISTINCT 'kb__' || location_id AS collection FROM catalog WHERE location_id <> 'src5'")(
    lambda t: rep.superseded_collections(t.select(F.concat(F.lit("kb__"), "location_id").alias("collection")), "kb__", "kb__src5")
)
DRIFT = """
    e AS (SELECT DISTINCT content_id, entry_id AS point_id FROM catalog WHERE content_id IS NOT NULL),
    a AS (SELECT content_id, entry_id AS point_id FROM catalog WHERE content_id IS NOT NULL AND k % 9 <> 4 UNION SELECT content_id, 'x' || entry_id FROM catalog WHERE content_id IS NOT NULL AND k % 11 = 2 UNION SELECT 'unknown', 'x1'),
    d AS (SELECT coalesce(e.content_id, a.content_id) AS content_id, coalesce(e.point_id, a.point_id) AS point_id, CASE WHEN a.point_id IS NULL THEN 'missing' WHEN e.point_id IS NULL THEN 'orphan' ELSE 'found' END AS kind
        FROM e FULL JOIN (SELECT * FROM a WHERE content_id IN (SELECT content_id FROM e)) a ON e.content_id = a.content_id AND e.point_id = a.point_id)"""


def drift(t):
    own = t.filter("content_id IS NOT NULL")
    extra = own.filter("k % 11 = 2").select("content_id", F.concat(F.lit("x"), "entry_id").alias("point_id"))
    stray = t.sparkSession.range(1).select(F.lit("unknown").alias("content_id"), F.lit("x1").alias("point_id"))
    actual = own.filter("k % 9 <> 4").select("content_id", F.col("entry_id").alias("point_id")).unionByName(extra).unionByName(stray)
    path = work_path(t.sparkSession, "drift")
    expected = own.select("content_id", F.col("entry_id").alias("point_id"))
    return rep.point_drift(rep.kept_points(expected, f"{path}/expected"), rep.kept_points(actual, f"{path}/actual"))


query("j10_u1_point_drift", "catalog", more=DRIFT, sql="SELECT * FROM d")(drift)
query(
    "a8_consistency_totals", "catalog", more=DRIFT,
    sql="SELECT count(DISTINCT content_id) AS contents, count(*) FILTER (WHERE kind <> 'orphan') AS expected, count(*) FILTER (WHERE kind = 'found') AS found, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'orphan') AS orphan, count(DISTINCT CASE WHEN kind <> 'found' THEN content_id END) AS drifted, count(*) FILTER (WHERE kind <> 'found') = 0 AS clean FROM d",
)(lambda t: rep.consistency_totals(drift(t)))
ROOTS = "SELECT location_id, num, enabled, CASE WHEN num % 4 = 0 THEN 'plain' ELSE 'windows' END AS family, CASE num % 4 WHEN 0 THEN '/data/' || CASE WHEN num % 8 = 0 THEN '' ELSE location_id || '/' END WHEN 3 THEN 'c:/docs/' ELSE 'c:/docs/' || location_id || '/' END AS root FROM {0}"
query(
    "j12_overlapping_roots", "locations", more=f"r AS ({ROOTS.format('locations')})",
    sql="SELECT DISTINCT least(x.location_id, y.location_id) AS a, greatest(x.location_id, y.location_id) AS b FROM r x JOIN r y ON x.family = y.family AND x.location_id <> y.location_id AND starts_with(x.root, y.root) WHERE x.enabled AND y.enabled",
)(lambda t: rep.overlapping_roots(t.sparkSession.sql(ROOTS.format("{t}"), t=t), F.col("root")))

# aggregations, windows, sorts

GROUPS = """g AS (
    SELECT 'exact' AS kind, sha256 AS group_hash, count(*) AS members FROM members GROUP BY sha256 HAVING count(*) >= 2
    UNION ALL SELECT 'text', text_hash, count(*) FROM members GROUP BY text_hash HAVING count(*) >= 2 AND count(DISTINCT sha256) >= 2)"""
query("a1_exact_duplicates", "members", more=GROUPS, sql="SELECT group_hash, members FROM g WHERE kind = 'exact'")(lambda t: rep.duplicate_groups(t).filter("kind = 'exact'").select("group_hash", "members"))
query("a2_text_duplicates", "members", more=GROUPS, sql="SELECT group_hash, members FROM g WHERE kind = 'text'")(lambda t: rep.duplicate_groups(t).filter("kind = 'text'").select("group_hash", "members"))
query("a3_u2_duplicate_report", "members", more=GROUPS, sql="SELECT * FROM g")(rep.duplicate_groups)
query("j15_t5_group_members", "members", more=GROUPS, sql="SELECT g.kind, g.group_hash, m.member_id FROM g JOIN members m ON CASE WHEN g.kind = 'exact' THEN m.sha256 ELSE m.text_hash END = g.group_hash")(
    lambda t: rep.duplicate_members(t, rep.duplicate_groups(t)).select("kind", "group_hash", "member_id").orderBy("kind", "group_hash", "member_id")
)
query("t4_largest_groups", "members", more=GROUPS, sql="SELECT kind, group_hash, members FROM g ORDER BY members DESC, kind, group_hash LIMIT 20")(
    lambda t: rep.duplicate_groups(t).orderBy(F.desc("members"), "kind", "group_hash").limit(20)
)
query(
    "a4_coverage", "catalog", "locations",
    sql="SELECT l.location_id, count(c.entry_id) AS total, count(*) FILTER (WHERE c.state = 'indexed') AS indexed, count(*) FILTER (WHERE c.state = 'missing') AS missing FROM locations l LEFT JOIN catalog c ON c.location_id = l.location_id AND c.location_id <> 'src7' GROUP BY l.location_id",
)(
    lambda cat, loc: rep.coverage(loc, cat.filter("location_id <> 'src7'")).select(
        "location_id", "total", *[F.coalesce(F.col("by_state")[s], F.lit(0).cast("long")).alias(s) for s in ("indexed", "missing")]
    )
)
query(
    "a7_k3_scan_summary", "jobs",
    sql="SELECT job_id AS root_job_id, count(*) FILTER (WHERE status = 'succeeded') AS indexed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('queued', 'running', 'retry_wait')) AS remaining, count(*) AS total FROM jobs GROUP BY job_id",
)(lambda t: rep.scan_summary(t.withColumnRenamed("job_id", "root_job_id")))
query("a9_p24_embed_decision", "catalog", sql="SELECT content_id, expected, stored, expected > 0 AND stored <> expected AS embed FROM (SELECT content_id, count(*) AS expected, count(*) FILTER (WHERE k % 4 > 0) AS stored FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id) x")(
    lambda t: embed_decision(t)
)


def embed_decision(t):
    from ..operators.embedding import not_yet_indexed

    own = t.filter("content_id IS NOT NULL")
    expected = own.groupBy("content_id").agg(F.count(F.lit(1)).alias("expected"))
    stored = own.filter("k % 4 > 0").select("content_id", F.lit("a").alias("chunking_profile"), F.lit("b").alias("embedding_profile"))
    return not_yet_indexed(expected, stored, "a", "b").select("content_id", "expected", "stored", "embed")


query(
    "a12_nearest_rank", "jobs",
    sql="SELECT phase, max(CASE WHEN i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN value END) AS p95, max(value) AS largest, round(avg(value), 6) AS mean FROM (SELECT phase, value, row_number() OVER (PARTITION BY phase ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM jobs WHERE value IS NOT NULL) x GROUP BY phase",
)(lambda t: rep.nearest_rank(t, ["phase"], "value", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 6)))
query("a13_open_work", "jobs", sql="SELECT job_id, count(*) FILTER (WHERE status IN ('queued', 'running', 'retry_wait')) AS open FROM jobs GROUP BY job_id")(
    lambda t: t.groupBy("job_id").agg(F.count_if(F.col("status").isin(*c.OPEN)).alias("open"))
)
query("a14_content_dedup", "catalog", sql="SELECT content_id, entry_id FROM (SELECT content_id, entry_id, row_number() OVER (PARTITION BY content_id ORDER BY created_at, entry_id) AS n FROM catalog WHERE content_id IS NOT NULL) x WHERE n = 1")(
    lambda t: rep.dedup_contents(t.filter("content_id IS NOT NULL"), ["content_id"], [F.col("created_at"), F.col("entry_id")]).select("content_id", "entry_id")
)
query("a15_distinct_contents", "catalog", sql="SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL")(lambda t: t.filter("content_id IS NOT NULL").select("content_id").distinct())
BACKUPS = """
    one AS (SELECT id, made_at, strftime(made_at, '%Y-%m-%d') AS d, printf('%04d-%02d', isoyear(made_at), week(made_at)) AS w, strftime(made_at, '%Y-%m') AS m FROM backups),
    b AS (SELECT id, made_at, 'd' AS f, d AS bucket, 3 AS n FROM one UNION ALL SELECT id, made_at, 'w', w, 2 FROM one UNION ALL SELECT id, made_at, 'm', m, 2 FROM one),
    newest AS (SELECT *, row_number() OVER (PARTITION BY f, bucket ORDER BY made_at DESC, id) AS k FROM b),
    kept AS (SELECT DISTINCT id FROM (SELECT id, n, row_number() OVER (PARTITION BY f ORDER BY bucket DESC) AS r FROM newest WHERE k = 1) x WHERE r <= n)"""
query("w4_u3_retained", "backups", more=BACKUPS, sql="SELECT id FROM kept")(lambda t: rep.retained(t, 3, 2, 2))
query("w5_pruned", "backups", more=BACKUPS, sql="SELECT id, made_at FROM backups WHERE id NOT IN (SELECT id FROM kept)")(lambda t: rep.pruned(t, rep.retained(t, 3, 2, 2)))
query("w6_s26_current_version", "jobs", sql="SELECT job_id, event_id FROM (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM jobs) x WHERE n = 1")(
    lambda t: c.latest(t, ["job_id"], [F.desc("ts"), F.desc("event_id")]).select("job_id", "event_id")
)
query("w7_event_sequence", "jobs", sql="SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS seq FROM jobs")(
    lambda t: rep.event_sequence(t).select("job_id", "event_id", F.col("seq").cast("long").alias("seq"))
)
query(
    "w8_monotone_progress", "jobs",
    sql="""SELECT job_id, event_id, max(current) OVER (PARTITION BY job_id, run ORDER BY ts, event_id) AS shown, max(CASE WHEN total IS NOT NULL THEN greatest(total, current) END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS shown_total
        FROM (SELECT *, sum(change) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY job_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS change FROM jobs) x) y""",
)(lambda t: rep.monotone_progress(t).select("job_id", "event_id", "shown", "shown_total"))
query("t1_document_page", "catalog", sql="SELECT entry_id, relative_path FROM catalog WHERE relative_path > 'd3/f20.txt' OR (relative_path = 'd3/f20.txt' AND entry_id > 'e5') ORDER BY relative_path, entry_id LIMIT 26")(
    lambda t: c.page(t.select("entry_id", "relative_path"), "relative_path", "entry_id", 25, after=("d3/f20.txt", "e5"))
)


def three_pages(t):
    """The first three pages of the catalog by path, each after the last row of the one before, from a layout by range."""
    table = PagedTable(t.sparkSession, work_path(t.sparkSession, "paged"), "relative_path", "entry_id")
    table.create(t.select("entry_id", "relative_path"))
    out, after = None, None
    for number in range(3):
        page = table.page(25, after)
        rows = page.limit(25)
        last = rows.agg(F.max(F.struct("relative_path", "entry_id")).alias("m")).first()["m"]
        after = tuple(last) if last else after
        rows = rows.withColumn("page", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


query(
    "p8_t1_three_pages", "catalog",
    sql="SELECT entry_id, relative_path, CAST((n - 1) // 25 AS INTEGER) AS page FROM (SELECT entry_id, relative_path, row_number() OVER (ORDER BY relative_path, entry_id) AS n FROM catalog) x WHERE n <= 75",
)(three_pages)
query("t6_newest_first", "jobs", sql="SELECT event_id, ts FROM jobs ORDER BY ts DESC, event_id DESC LIMIT 51")(lambda t: t.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(51))
NAMES = "n AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || strftime(ts, '%Y%m%dT%H%M%SZ') AS name, event_id, ts FROM jobs)"
query("t7_completed_sets", "jobs", more=NAMES, sql="SELECT DISTINCT name, date_trunc('second', ts) AS made_at FROM n WHERE event_id % 5 <> 0 AND name IN (SELECT name FROM n WHERE event_id % 3 = 0)")(
    lambda t: completed(t.select(F.concat(F.when(F.col("event_id") % 5 == 0, "x").otherwise(""), times.backup_id(F.col("ts"))).alias("name"), "event_id"))
)


def completed(names):
    return rep.completed_sets(names.select("name").distinct(), names.filter("event_id % 3 = 0"))


query("p4_projections", "members", more=GROUPS, sql="SELECT kind, upper(substr(group_hash, 1, 8)) AS short, members FROM g")(lambda t: rep.duplicate_groups(t).select("kind", F.upper(F.substring("group_hash", 1, 8)).alias("short"), "members"))
query(
    "k2_expired_leases", "jobs",
    sql="SELECT job_id, event_id, CASE WHEN event_id % 10 = 0 THEN 'cancelled' WHEN attempt >= 4 THEN 'failed' ELSE 'retry_wait' END AS outcome FROM (SELECT job_id, event_id, row_number() OVER w AS attempt, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM jobs WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE gap > 3600",
)(lambda t: rep.expired_leases(t.withColumn("cancel", F.col("event_id") % 10 == 0), 3600, 4).select("job_id", "event_id", "outcome"))
