"""Queries over texts: functions, sections, chunks, embeddings, search, evidence, citations, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, paths, text, times, vectors
from ..operators import chunking, embedding, rag, search
from ..sources import files
from .registry import query

NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TOKENS = rf"list_filter(string_split({NORM}, ' '), lambda t: t <> '')"


def T(name: str):
    return F.col(name)


# scalar functions

query("f1_normalize", "docs", sql=f"SELECT doc_id, {NORM.format('nfc_normalize(text)')} AS t FROM docs")(lambda d: d.select("doc_id", text.normalize_text(T("text")).alias("t")))
query("f2_token_count", "docs", sql=f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n FROM docs")(lambda d: d.select("doc_id", text.token_count(T("text")).alias("n")))
query("f3_truncate", "docs", sql=f"SELECT doc_id, CASE WHEN len({TOKENS.format('text')}) <= 12 THEN text ELSE array_to_string(({TOKENS.format('text')})[1:12], ' ') END AS t FROM docs")(
    lambda d: d.select("doc_id", text.truncate_tokens(T("text"), 12).alias("t"))
)
query("f4_snippet", "docs", sql="SELECT doc_id, CASE WHEN length(trim(text)) <= 320 THEN trim(text) ELSE regexp_replace(substr(trim(text), 1, 320), ' [^ ]*$', '') || '…' END AS t FROM docs")(
    lambda d: d.select("doc_id", text.snippet(T("text")).alias("t"))
)
query(
    "f5_keyword_terms", "docs", more=r"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}') AS a FROM docs)",
    sql="SELECT doc_id, CAST(len(list_distinct(a)) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(a)), ' ') AS terms FROM w",
)(lambda d: d.select("doc_id", text.keyword_terms(T("text")).alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.array_join(F.array_sort("a"), " ").alias("terms")))
SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {list(v)})" for k, v in text.SYNONYMS.items()) + ") v(k, s))"
JOB = "CASE doc_id % 4 WHEN 0 THEN 'Job''s of ' WHEN 1 THEN 'The PHONE x ' WHEN 2 THEN 'resume salary ' ELSE '' END || text"
query(
    "f6_expand_terms", "docs",
    more=rf"w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower({JOB}), '[''’]s\b', '', 'g'), '[\p{{L}}\p{{N}}]{{2,}}') AS a FROM docs), {SYN}",
    sql="SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a, coalesce((SELECT flatten(list(s)) FROM syn WHERE list_contains(a, k)), [])))), ' ') AS terms FROM w",
)(lambda d: d.select("doc_id", F.array_join(F.array_sort(text.expand_terms(F.expr(JOB.replace("Job''s", "Job\\'s")))), " ").alias("terms")))
query("f7_embedding_context", "catalog", sql=r"SELECT entry_id, trim(regexp_replace(relative_path, '[._/\\-]+', ' ', 'g')) AS t FROM catalog")(
    lambda d: d.select("entry_id", paths.embedding_context(T("relative_path")).alias("t"))
)
query("f8_extension", "catalog", sql=r"SELECT entry_id, lower(regexp_extract(f, '^.+\.([^.]+)$', 1)) AS ext FROM (SELECT entry_id, upper(list_last(string_split(relative_path, '/'))) AS f FROM catalog) x")(
    lambda d: d.select("entry_id", paths.extension(F.upper(paths.file_name(T("relative_path")))).alias("ext"))
)
DISPLAY = r"CASE WHEN l.num % 4 = 0 THEN rtrim(display_root, '/') || '/' || relative_path ELSE rtrim(display_root, '\/') || '\' || replace(relative_path, '/', '\') END"


def displayed(cat: DataFrame, loc: DataFrame) -> DataFrame:
    return cat.join(loc.select("location_id", "path_style", "display_root"), "location_id").withColumn("display_path", paths.display_path(T("path_style"), T("display_root"), T("relative_path")))


query("f9_f10_display_path", "catalog", "locations", sql=f"SELECT entry_id, {DISPLAY} AS display_path, list_last(string_split(relative_path, '/')) AS name FROM catalog JOIN locations l USING (location_id)")(
    lambda cat, loc: displayed(cat, loc).select("entry_id", "display_path", paths.source_name(T("display_path")).alias("name"))
)
PAGES = "SELECT entry_id, CASE WHEN k % 3 > 0 THEN k END AS a, CASE WHEN k % 5 > 0 THEN k + k % 2 END AS b FROM {0}"
query("f11_page_tag", "catalog", more=f"p AS ({PAGES.format('catalog')})", sql="SELECT entry_id, CASE WHEN a IS NULL THEN '' WHEN b IS NULL OR a = b THEN ' (page ' || a || ')' ELSE ' (pages ' || a || '–' || b || ')' END AS tag FROM p")(
    lambda t: t.sparkSession.sql(PAGES.format("{t}"), t=t).select("entry_id", paths.page_tag(T("a"), T("b")).alias("tag"))
)
query("f12_f13_names", "catalog", sql="SELECT entry_id, 'kb__baai-bge-' || replace(replace(lower(relative_path), '/', '-'), '.', '-') || '__' || substr(sha256, 1, 12) AS collection, 'v1/' || substr(sha256, 1, 2) || '/' || sha256 || '.' || substr(text_hash, 1, 12) || '.json.gz' AS address FROM catalog")(
    lambda t: t.select("entry_id", ids.collection_name("kb", F.concat(F.lit("BAAI/bge_"), "relative_path", F.lit("!")), T("sha256")).alias("collection"), ids.content_address(F.lit("v1"), T("sha256"), T("text_hash")).alias("address"))
)
query("f15_extension_list", "catalog", sql="SELECT entry_id, CASE WHEN k % 4 <> 0 THEN extension || ',' || lower(location_id) END AS list FROM catalog")(
    lambda t: t.select("entry_id", F.array_join(paths.normalize_extensions(F.array(F.concat(F.lit(" ."), F.upper("extension"), F.lit(" ")), F.when(T("k") % 4 == 0, " . ").otherwise(F.upper("location_id")))), ",").alias("list"))
)
query("f20_text_hash", "docs", sql=f"SELECT doc_id, sha256({NORM.format('text')}) AS h FROM docs")(lambda d: d.select("doc_id", ids.text_hash(F.split("text", "\n")).alias("h")))
STRUCTURE = r"""SELECT doc_id, sha256('[' || array_to_string(list_transform(string_split(text, chr(10)), lambda t, i: '[' || CASE WHEN i % 3 = 0 THEN 'null' ELSE CAST(i AS STRING) END || ',"' || replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(13), '\r') || '"]'), ',') || ']') AS h FROM docs"""
query("f21_structure_hash", "docs", sql=STRUCTURE)(
    lambda d: d.select("doc_id", ids.structure_hash(F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.when((i + 1) % 3 != 0, i + 1).alias("page_number"), t.alias("text")))).alias("h"))
)
PROFILE_JSON = '{"overlap_tokens":20,"target_tokens":100,"tokenizer_id":"whitespace-1","version":"chunk-1"}'
query("f22_profile_hashes", "locations", sql=f"SELECT location_id, sha256('{PROFILE_JSON}') AS chunking FROM locations")(lambda t: t.select("location_id", F.lit(ids.chunking_profile(100, 20)).alias("chunking")))
UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def uuid_sql(namespace: str, name: str) -> str:
    return f"SELECT doc_id, {UUID} AS id FROM (SELECT doc_id, sha1(from_hex('{namespace.replace('-', '')}') || encode({name})) AS h FROM docs) x"


query("f23_chunk_id", "docs", sql=uuid_sql(ids.CHUNK_NAMESPACE, "'c' || doc_id || ':abc:' || num"))(lambda d: d.select("doc_id", ids.chunk_id(F.concat(F.lit("c"), T("doc_id").cast("string")), F.lit("abc"), T("num")).alias("id")))
query("f24_point_id", "docs", sql=uuid_sql(ids.POINT_NAMESPACE, "'c' || doc_id || ':abc:def:' || num"))(
    lambda d: d.select("doc_id", ids.point_id(F.concat(F.lit("c"), T("doc_id").cast("string")), F.lit("abc"), F.lit("def"), T("num")).alias("id"))
)
query("f26_fingerprint", "catalog", sql="""SELECT entry_id, sha256('{"extension":"' || extension || '","path":"' || relative_path || '","state":"' || state || '"}') AS h FROM catalog""")(
    lambda t: t.select("entry_id", ids.map_checksum(F.create_map(F.lit("state"), "state", F.lit("path"), "relative_path", F.lit("extension"), "extension")).alias("h"))
)
query("f30_rfc3339", "jobs", sql="SELECT event_id, regexp_replace(regexp_replace(strftime(t, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || 'Z' AS t FROM (SELECT event_id, ts + to_microseconds(event_id % 7 * 1500) AS t FROM jobs) x")(
    lambda t: t.select("event_id", times.iso_utc(T("ts") + F.make_dt_interval(secs=((T("event_id") % 7 * 1500) / 1_000_000).cast("decimal(18,6)"))).alias("t"))
)
query("f31_f32_times", "jobs", sql="SELECT event_id, make_timestamp(CAST(floor(value) AS BIGINT) * 1000000) AS at_epoch, strftime(ts, '%Y%m%dT%H%M%SZ') AS backup_id, date_trunc('second', ts) AS parsed FROM jobs")(
    lambda t: t.select("event_id", times.from_epoch(F.floor("value")).alias("at_epoch"), times.backup_id(T("ts")).alias("backup_id"), times.backup_time(times.backup_id(T("ts"))).alias("parsed"))
)
query("f33_buckets", "jobs", sql="SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, format('{:04d}-{:02d}', isoyear(ts), week(ts)) AS w, strftime(ts, '%Y-%m') AS m FROM jobs")(
    lambda t: t.select("event_id", times.day_bucket(T("ts")).alias("d"), times.week_bucket(T("ts")).alias("w"), times.month_bucket(T("ts")).alias("m"))
)
query("f34_intervals", "jobs", sql="SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR AS stale FROM jobs")(
    lambda t: t.select("event_id", times.before_cutoff(T("ts"), F.lit("2024-01-15").cast("timestamp_ntz"), 24).alias("stale"))
)
PAIR = "pair AS (SELECT a.point_id, CAST(a.vector AS DOUBLE[]) AS x, CAST(q.vector AS DOUBLE[]) AS y FROM points a, points q WHERE q.doc_id = 3)"


def paired(p: DataFrame) -> DataFrame:
    return p.select("point_id", T("vector").alias("x")).crossJoin(F.broadcast(p.filter("doc_id = 3").select(T("vector").alias("y"))))


query("f40_distances", "points", more=PAIR, sql="SELECT point_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_dot_product(x, y), 6) AS dot, round(list_distance(x, y), 6) AS euclid FROM pair")(
    lambda p: paired(p).select("point_id", F.round(vectors.cosine(T("x"), T("y")), 6).alias("cosine"), F.round(vectors.dot(T("x"), T("y")), 6).alias("dot"), F.round(vectors.euclid(T("x"), T("y")), 6).alias("euclid"))
)
query("f41_unit_vectors", "points", sql="SELECT point_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM (SELECT point_id, CAST(vector AS DOUBLE[]) AS v FROM points) x")(
    lambda p: p.select("point_id", vectors.normalize(T("vector")).alias("v")).select("point_id", F.round(T("v")[0], 6).alias("first"), F.round(T("v")[63], 6).alias("last"))
)
query("f42_f43_scores", "docs", sql="SELECT doc_id, round(1.0::DOUBLE / (60 + num), 6) AS term, CASE WHEN num > 0 THEN round_even(k * 100.0 / num, 1) ELSE 0 END::DOUBLE AS pct FROM docs")(
    lambda d: d.select("doc_id", F.round(vectors.rrf_term(T("num")), 6).alias("term"), vectors.percent(T("k"), T("num")).alias("pct"))
)

# sections and chunks

query(
    "s10_a10_text_sections", "docs",
    more=r"p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n[ \t]*\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS a FROM docs)",
    sql="SELECT doc_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS index, unnest(a) AS section FROM p",
)(lambda d: chunking.text_sections(d.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n \n"))), "doc_id"))
query(
    "s11_csv_sections", "jobs",
    more="c AS (SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY event_id) AS i, 'id: ' || event_id || ' | job: ' || job_id AS line FROM jobs)",
    sql="SELECT phase, CAST((i - 1) // 100 AS INTEGER) AS index, 'id | job' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS section FROM c GROUP BY phase, (i - 1) // 100",
)(lambda t: csv_rows(t))


def csv_rows(jobs: DataFrame) -> DataFrame:
    """A CSV file of each phase: a header, blank rows, and an extra cell that has no header."""
    s = lambda c: F.col(c).cast("string")
    data = jobs.select("phase", T("event_id").alias("line"), F.array(s("event_id"), s("job_id"), F.lit("extra")).alias("cells"))
    header = jobs.select("phase").distinct().select("phase", F.lit(-2).cast("long").alias("line"), F.array(F.lit("id "), F.lit("job")).alias("cells"))
    blank = jobs.select("phase").distinct().select("phase", F.lit(-1).cast("long").alias("line"), F.array(F.lit(" "), F.lit("")).alias("cells"))
    return chunking.csv_sections(data.unionByName(header).unionByName(blank), "phase", "line")


def page_rows(docs: DataFrame) -> DataFrame:
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))
    return pages.withColumn("page_number", T("index") + 1)


CHUNKS = rf"""
    pages AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS page, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs) x),
    own AS (SELECT doc_id, page, {TOKENS.format('t')} AS toks FROM pages),
    n AS (SELECT doc_id, page, toks, CAST(len(toks) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM own WHERE len(toks) > 0),
    walk AS (
        SELECT doc_id, page, toks, n, i, 0 AS g, n AS run FROM n WHERE i = 1
        UNION ALL SELECT n.doc_id, n.page, n.toks, n.n, n.i, CASE WHEN w.n > 100 OR n.n > 100 OR w.run + n.n > 100 THEN w.g + 1 ELSE w.g END, CASE WHEN w.n > 100 OR n.n > 100 OR w.run + n.n > 100 THEN n.n ELSE w.run + n.n END
        FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
    packs AS (SELECT doc_id, g, flatten(list(toks ORDER BY i)) AS toks, min(page) AS page_start, max(page) AS page_end FROM walk GROUP BY doc_id, g),
    cut AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(toks) - 100) / 80.0)) AS BIGINT) + 1)) AS w FROM packs),
    chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, w) - 1 AS INTEGER) AS chunk_index, toks[w * 80 + 1 : w * 80 + 100] AS c, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM cut)"""
CHUNKS_OF_200 = CHUNKS[CHUNKS.index("own AS (") :].replace("- 100) / 80.0", "- 200) / 180.0").replace("w * 80 + 1 : w * 80 + 100", "w * 180 + 1 : w * 180 + 200").replace("> 100", "> 200")
#: The chunks of the distinct contents of ``documents``: the text of the smallest id, cut at blank lines.
INDEXED = rf"""
    bodies AS (SELECT doc_id, text, sha256({NORM.format('nfc_normalize(text)')}) AS content_id FROM documents WHERE text IS NOT NULL),
    contents AS (SELECT content_id, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM bodies GROUP BY content_id),
    secs AS (SELECT content_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS a FROM contents),
    pages AS (SELECT content_id AS doc_id, unnest(range(1, len(a) + 1)) AS page, unnest(a) AS t FROM secs),
    {CHUNKS_OF_200},
    cs AS (SELECT doc_id AS content_id, chunk_index, array_to_string(c, ' ') AS text, CAST(len(c) AS BIGINT) AS token_count FROM chunks)"""
PROFILE = ids.chunking_profile(200, 20)


def uuid_of(namespace: str, name: str) -> str:
    return UUID.replace("(h,", f"(sha1(from_hex('{namespace.replace('-', '')}') || encode({name})),")


INDEXED_SQL = f"SELECT content_id, {uuid_of(ids.CHUNK_NAMESPACE, f"content_id || ':{PROFILE}:' || chunk_index")} AS chunk_id, chunk_index, text, token_count, sha256(text) AS text_hash FROM cs"
query(
    "r1_r2_w3_chunks", "docs", more=CHUNKS,
    sql="SELECT doc_id, chunk_index, CAST(len(c) AS BIGINT) AS token_count, page_start, page_end, sha256(array_to_string(c, ' ')) AS text_hash FROM chunks",
)(lambda d: chunking.chunk_pages(page_rows(d), "doc_id", 100, 20).drop("text"))

# embedding and search

HASHED = r"""
    w AS (SELECT entry_id, unnest(list_distinct(regexp_extract_all(lower('[File: ' || trim(regexp_replace(relative_path, '[._/\\-]+', ' ', 'g')) || ']' || chr(10) || text), '[\p{L}\p{N}]{2,}'))) AS t FROM catalog),
    slots AS (SELECT entry_id, CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) % 8 AS s, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
    norms AS (SELECT entry_id, sqrt(sum(n * n)) AS z FROM slots GROUP BY entry_id)"""
query("r3_hashed_embedding", "catalog", more=HASHED, sql="SELECT entry_id, s AS slot, round(n / z, 6) AS value FROM slots JOIN norms USING (entry_id)")(
    lambda t: t.select("entry_id", F.posexplode(embedding.hashed(embedding.with_context(T("text"), T("relative_path")), 8)).alias("slot", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))
)


class Counting:
    """A small model: a passage's characters and words; a query has a third number."""

    def embed(self, texts):
        return [[float(len(t)), float(len(t.split(" ")))] for t in texts]

    def embed_query(self, text):
        return [[*self.embed([text])[0], 1.0]]


query("r3_x3_passage_model", "docs", sql="SELECT doc_id, CAST(length(text) AS FLOAT) AS characters, CAST(len(string_split(text, ' ')) AS FLOAT) AS words FROM docs")(
    lambda d: embedding.embed(d.select("doc_id", "text"), "text", 2, Counting).select("doc_id", T("vector")[0].alias("characters"), T("vector")[1].alias("words"))
)
query("r3b_query_vectors", "queries", sql="SELECT query_id, CAST(length(question) AS FLOAT) AS characters, CAST(len(string_split(question, ' ')) AS FLOAT) AS words, CAST(1 AS FLOAT) AS one FROM queries")(
    lambda q: embedding.embed_queries(q.select("query_id", "question"), "question", 3, Counting).select("query_id", *[T("vector")[i].alias(n) for i, n in enumerate(("characters", "words", "one"))])
)
query(
    "x1_other_tokenizer", "docs", more=CHUNKS.replace(TOKENS.format("t"), "regexp_extract_all(lower(t), '[a-z0-9]+')"),
    sql="SELECT doc_id, chunk_index, CAST(len(c) AS BIGINT) AS token_count, page_start, page_end, sha256(array_to_string(c, ' ')) AS text_hash FROM chunks",
)(
    lambda d: chunking.chunk_pages(page_rows(d), "doc_id", 100, 20, tokenize=lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))).drop("text")
)


def by_lines():
    """An extractor of numbered lines that refuses files beginning with a capital A."""

    def run(path: str, content: bytes) -> list[tuple[int, str]]:
        if content.startswith(b"A"):
            raise ValueError(path)
        return [(i + 1, line) for i, line in enumerate(content.decode().split("\n"))]

    return run


query(
    "x2_extractor", "docs", more="p AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, string_split(text, chr(10)) AS a FROM docs)",
    sql="SELECT path, CAST(i - 1 AS INTEGER) AS index, CAST(i AS INTEGER) AS page_number, a[i] AS text, NULL::VARCHAR AS error FROM (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM p WHERE NOT starts_with(text, 'A')) x UNION ALL SELECT path, NULL, NULL, NULL, 'ValueError' FROM p WHERE starts_with(text, 'A')",
)(
    lambda d: files.extract(d.select(T("doc_id").cast("string").alias("path"), T("text").cast("binary").alias("content")), by_lines)
)
ALLOWED = "SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL AND location_id IN ('src1', 'src2', 'src3') AND extension IN ('md', 'txt') AND state = 'indexed'"
query("p11_allowed_contents", "catalog", sql=ALLOWED)(lambda t: search.allowed_contents(t, ["src1", "src2", "src3"], ["md", "txt"]))
SCORED = SYN + r""",
    pt AS (SELECT point_id, vector, regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}') AS t FROM points),
    qw AS (SELECT query_id, vector, regexp_extract_all(regexp_replace(lower(question), '[''’]s\b', '', 'g'), '[\p{L}\p{N}]{2,}') AS a FROM queries),
    qt AS (SELECT query_id, vector, list_concat(a, coalesce((SELECT flatten(list(s)) FROM syn WHERE list_contains(a, k)), [])) AS t FROM qw),
    s AS (SELECT q.query_id, p.point_id, round(list_cosine_similarity(CAST(p.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6) AS score, list_has_any(p.t, q.t) AS hit FROM pt p, qt q),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS r FROM s WHERE score >= 0.05 QUALIFY r <= 12),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS r FROM s WHERE hit QUALIFY r <= 12),
    f AS (SELECT query_id, point_id, coalesce(v.score, k.score) AS score, v.r AS vr, k.r AS kr, coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + k.r), 0) AS fused FROM v FULL JOIN k USING (query_id, point_id)),
    h AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vr NULLS LAST, kr NULLS LAST) AS rank FROM f QUALIFY rank <= 12)"""


def prepared(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.withColumn("terms", text.keyword_terms(T("text"))), queries.withColumn("terms", search.query_terms(T("question")))


def long_rank(df: DataFrame) -> DataFrame:
    return df.select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


query("j14_t2_p12_w2_vector_search", "points", "queries", more=SCORED, sql="SELECT query_id, point_id, score, r AS rank FROM v")(lambda p, q: long_rank(search.vector_leg(p, q, 12, threshold=0.05)))
query("p13_keyword_search", "points", "queries", more=SCORED, sql="SELECT query_id, point_id, score, r AS rank FROM k")(lambda p, q: long_rank(search.keyword_leg(*prepared(p, q), 12)))
query("r4_r4b_t3_hybrid_search", "points", "queries", more=SCORED, sql="SELECT * FROM h")(lambda p, q: long_rank(search.hybrid(*prepared(p, q), 12, threshold=0.05)))
ENTRY = "SELECT 'c' || doc_id AS content_id, entry_id, location_id, relative_path AS display_path, state, created_at, k FROM {0}"
FIRST = f"en AS ({ENTRY.format('catalog')}), first AS (SELECT content_id, min(1) AS one, arg_min(entry_id, (created_at, entry_id)) AS primary_id, arg_min(state, (created_at, entry_id)) AS state, count(*) AS n FROM en GROUP BY content_id)"
LABEL = "CASE state WHEN 'indexed' THEN 'current' WHEN 'missing' THEN 'missing' ELSE 'historical' END AS availability"


def entries(cat: DataFrame) -> DataFrame:
    return cat.sparkSession.sql(ENTRY.format("{t}"), t=cat)


query("j11_w1_p20_resolved_paths", "catalog", more=FIRST, sql=f"SELECT content_id, primary_id, n, {LABEL} FROM first")(
    lambda t: search.resolved_paths(entries(t)).select("content_id", T("primary.entry_id").alias("primary_id"), T("n_paths").alias("n"), search.availability(T("primary.state")).alias("availability"))
)
query(
    "r4c_full_search", "points", "queries", "catalog", more=SCORED + ", " + FIRST,
    sql=f"SELECT query_id, point_id, score, rank, primary_id, {LABEL}, CASE WHEN length(trim(text)) <= 320 THEN trim(text) ELSE regexp_replace(substr(trim(text), 1, 320), ' [^ ]*$', '') || '…' END AS snippet FROM h JOIN points USING (point_id) LEFT JOIN first USING (content_id)",
)(
    lambda p, q, cat: search.search(*prepared(p, q), entries(cat), 12, threshold=0.05).select("query_id", "point_id", "score", T("rank").cast("long").alias("rank"), T("primary.entry_id").alias("primary_id"), "availability", "snippet")
)

# evidence, prompts, citations, policies, chats

EVIDENCE = rf"""
    c AS (SELECT question_id, rank, content_id, trim(text) AS text, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM hits),
    walk AS (
        SELECT question_id, i, CASE WHEN n > 0 THEN least(n, 120) ELSE 0 END AS total, CASE WHEN n > 0 THEN [content_id] ELSE [] END AS taken, n > 0 AS take, CASE WHEN n > 0 THEN least(n, 120) ELSE 0 END AS cost FROM c WHERE i = 1
        UNION ALL
        SELECT question_id, i, total + CASE WHEN take THEN cost ELSE 0 END, CASE WHEN take THEN list_append(taken, content_id) ELSE taken END, take, CASE WHEN take THEN cost ELSE 0 END FROM (
            SELECT c.question_id, c.i, c.content_id, w.total, w.taken, least(c.n, 120) AS cost,
                len(w.taken) < 4 AND len(list_filter(w.taken, lambda x: x = c.content_id)) < 2 AND c.n > 0 AND (len(w.taken) = 0 OR w.total + c.n <= 120) AS take
            FROM walk w JOIN c ON c.question_id = w.question_id AND c.i = w.i + 1) x),
    blocks AS (SELECT question_id, c.rank, c.content_id, w.cost AS tokens, 'E' || len(w.taken) AS alias, CASE WHEN n <= 120 THEN text ELSE array_to_string(({TOKENS.format('text')})[1:120], ' ') END AS text FROM walk w JOIN c USING (question_id, i) WHERE take)"""


def evidence(h: DataFrame) -> DataFrame:
    return rag.select_evidence(h, 120, 2, 4)


query("r5_w10_evidence", "hits", more=EVIDENCE, sql="SELECT question_id, alias, rank, content_id, tokens, text FROM blocks")(lambda h: evidence(h).select("question_id", "alias", "rank", "content_id", "tokens", "text"))
query("a11_evidence_totals", "hits", more=EVIDENCE, sql="SELECT question_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS blocks FROM blocks GROUP BY question_id")(lambda h: rag.evidence_totals(evidence(h)))
query("r6_evidence_budget", "docs", sql="SELECT doc_id, greatest(256, CASE WHEN num % 2 = 0 THEN least(num * 500 - 256 - 512, 4000) ELSE num * 500 - 256 - 512 END) AS budget FROM docs")(
    lambda d: d.select("doc_id", rag.evidence_budget(T("num") * 500, F.lit(256), T("num") % 2 == 0, 4000).cast("long").alias("budget"))
)
query(
    "r7_prompt", "hits", more=EVIDENCE,
    sql="SELECT question_id, 'Answer from the evidence only.' || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg('[' || alias || ']' || CASE WHEN rank % 2 = 0 THEN ' (file: ' || content_id || ')' ELSE '' END || ' (page ' || rank || ') ' || text, chr(10) ORDER BY rank) AS prompt FROM blocks GROUP BY question_id",
)(
    lambda h: rag.grounded_prompt(evidence(h).withColumns({"name": F.expr("CASE WHEN rank % 2 = 0 THEN content_id END"), "page_start": T("rank"), "page_end": F.lit(None).cast("int")}), "Answer from the evidence only.")
)
query(
    "r8_w9_citations", "answers",
    sql=r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'E2,E1' WHEN 1 THEN 'E3' ELSE '' END AS citations, turn % 4 IN (1, 2) AS warned,
        CASE turn % 4 WHEN 0 THEN replace(replace(answer, '[E2]', '[1]'), '[E1]', '[2]') WHEN 1 THEN replace(replace(answer, '[E9]', ''), '[E3]', '[1]') WHEN 2 THEN replace(answer, '[E01]', '') ELSE answer END AS rewritten FROM answers""",
)(
    lambda t: rag.map_citations(t.withColumn("aliases", F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")))).select("conv_id", "turn", F.array_join("citations", ",").alias("citations"), (F.size("warnings") > 0).alias("warned"), "rewritten")
)
query("p25_answer_status", "answers", sql="SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'refused' WHEN conv_id % 9 = 0 THEN 'insufficient_evidence' ELSE 'completed' END AS status FROM answers")(
    lambda t: t.select("conv_id", "turn", rag.answer_status(T("answer"), F.when(T("turn") % 5 == 3, "no")).alias("status"))
)
LINKS = "SELECT DISTINCT conv_id AS question_id, 'src' || ((conv_id + turn * 2) % 22) AS location_id FROM {0}"
POLICY = f"e AS ({LINKS.format('answers')}), pol AS (SELECT question_id, location_id, coalesce(policy, 'deny') AS policy FROM e LEFT JOIN locations USING (location_id)), q AS (SELECT DISTINCT conv_id AS question_id, conv_id % 5 <> 0 AS external, conv_id % 7 <> 0 AS external_enabled, conv_id % 3 = 0 AS acknowledged FROM answers)"


def linked(t: DataFrame) -> DataFrame:
    return t.sparkSession.sql(LINKS.format("{t}"), t=t)


query("j13_u5_source_policies", "answers", "locations", more=POLICY, sql="SELECT * FROM pol")(lambda a, loc: rag.source_policies(linked(a), loc).select("question_id", "location_id", "policy"))
query(
    "p22_external_policy", "answers", "locations", more=POLICY,
    sql="SELECT question_id, CASE WHEN NOT external THEN 'allowed' WHEN NOT external_enabled OR denied > 0 THEN 'denied' WHEN NOT acknowledged THEN 'confirmation_required' ELSE 'allowed' END AS decision, CASE WHEN external AND external_enabled THEN denied ELSE 0 END AS denied_sources FROM q JOIN (SELECT question_id, count(*) FILTER (WHERE policy <> 'allow') AS denied FROM pol GROUP BY question_id) d USING (question_id)",
)(
    lambda a, loc: rag.external_decision(
        a.selectExpr("conv_id AS question_id", "conv_id % 5 <> 0 AS external", "conv_id % 7 <> 0 AS external_enabled", "conv_id % 3 = 0 AS acknowledged").distinct(), rag.source_policies(linked(a), loc)
    ).select("question_id", "decision", "denied_sources")
)
query("p23_payload", "hits", more=EVIDENCE, sql="SELECT question_id, question_id % 2 = 0 AS sent, CASE WHEN question_id % 2 = 0 THEN count(*) ELSE 0 END AS blocks_sent, CASE WHEN question_id % 2 = 0 THEN CAST(sum(length(text)) AS BIGINT) ELSE 0 END AS characters_sent FROM blocks GROUP BY question_id")(
    lambda h: rag.evidence_totals(evidence(h)).select("question_id", rag.payload(T("question_id") % 2 == 0, T("blocks"), T("characters"), T("blocks")).alias("p")).select("question_id", T("p.question_sent").alias("sent"), "p.blocks_sent", "p.characters_sent")
)
query(
    "r12_history_bounds", "conversations",
    sql="SELECT conv_id, count(*) AS turns, CASE WHEN count(*) > 20 THEN 'too_many_turns' WHEN count(*) FILTER (WHERE length(text) > 8000 OR text IS NULL OR length(text) = 0) > 0 THEN 'bad_turn' WHEN count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) > 0 THEN 'bad_role' END AS problem FROM conversations GROUP BY conv_id",
)(rag.history_problem)
