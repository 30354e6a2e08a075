"""Tables of the catalog's shape derived from the given tables.

Each is one SQL text; ``{name}`` stands for another table.  Spark gets it as
``spark.sql`` with DataFrames for the names, the comparison engine as a common
table expression.  A handful of functions differ between the two dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "docs": "SELECT doc_id, coalesce(text, '') AS text, source AS location_id, CAST(substr(source, 4) AS BIGINT) AS num, CAST(floor(doc_id / 20) AS BIGINT) AS k FROM {documents}",
    "locations": """
        SELECT location_id, num, 'location ' || location_id AS name,
            CASE num % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'unc' ELSE 'mapped_drive' END AS path_style,
            CASE num % 4 WHEN 0 THEN '/data/' || location_id || '/' WHEN 1 THEN 'C:' || chr(92) || 'Docs' || chr(92) || location_id
                WHEN 2 THEN chr(92) || chr(92) || 'server' || chr(92) || 'share' || chr(92) || location_id ELSE 'Z:' || chr(92) || location_id || chr(92) END AS display_root,
            num % 5 <> 4 AS enabled, CASE WHEN num % 2 = 0 THEN 'allow' ELSE 'deny' END AS policy,
            CASE WHEN num % 6 <> 5 THEN 's' || num END AS sentinel_id,
            CASE WHEN num % 3 <> 2 THEN 60 + num END AS interval_minutes,
            CASE WHEN num % 8 <> 7 THEN TS(1767225600 + num * 600) END AS last_scan
        FROM (SELECT DISTINCT location_id, num FROM {docs}) x""",
    "sentinels": "SELECT location_id, CASE WHEN num % 9 = 8 THEN 'other' WHEN num % 7 <> 6 THEN 's' || num END AS observed_sentinel FROM {locations}",
    "entries": """
        SELECT 'e' || doc_id AS entry_id, location_id, 'd' || (k % 7) || '/f' || k || '.' || EXT(k) AS relative_path, doc_id, k, text FROM {docs}
        UNION ALL
        SELECT 't' || doc_id, location_id, 'twin/f' || k || '.' || EXT(k), doc_id, k, text FROM {docs} WHERE k % 20 = 1""",
    "catalog": """
        SELECT entry_id, location_id, relative_path, EXT(k) AS extension, k, doc_id, text, CAST(length(text) AS BIGINT) AS size, TS(1735689600 + doc_id * 60) AS mtime, SHA(text) AS sha256, NORMHASH(text) AS text_hash,
            CASE doc_id % 11 WHEN 3 THEN 'missing' WHEN 4 THEN 'failed' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'discovered' ELSE 'indexed' END AS state,
            CASE WHEN doc_id % 11 = 3 THEN TS(1735689600) END AS missing_at,
            CASE WHEN doc_id % 11 < 9 AND doc_id % 11 <> 5 THEN 'c' || SHA(text) END AS content_id,
            TS(1735689600 + (doc_id % 97) * 3600) AS created_at,
            CASE WHEN doc_id % 11 IN (4, 5) THEN 'malformed' END AS error_code
        FROM {entries}""",
    "observed": """
        SELECT location_id, CASE WHEN k % 10 = 1 THEN 'moved/' || relative_path ELSE relative_path END AS relative_path,
            SHA(CASE WHEN k % 10 = 2 THEN text || ' x' ELSE text END) AS sha256,
            CAST(length(text) + CASE WHEN k % 10 = 2 THEN 2 ELSE 0 END AS BIGINT) AS size,
            TS(1735689600 + doc_id * 60 + CASE WHEN k % 10 = 3 THEN 60 ELSE 0 END) AS mtime
        FROM {entries} WHERE k % 10 <> 0 AND NOT (k % 10 = 1 AND substr(entry_id, 1, 1) = 't')
        UNION ALL
        SELECT location_id, 'new/f' || doc_id || '.txt', SHA(text || ' new'), CAST(length(text) + 4 AS BIGINT), TS(1735689600 + doc_id * 60) FROM {docs} WHERE doc_id % 13 = 0""",
    "mirror": """
        SELECT location_id, CASE k % 6 WHEN 2 THEN 'r/' || relative_path WHEN 3 THEN 't/' || relative_path ELSE relative_path END AS relative_path,
            SHA(CASE k % 6 WHEN 1 THEN text || ' x' WHEN 3 THEN replace(text, ' ', '  ') ELSE text END) AS sha256,
            NORMHASH(CASE k % 6 WHEN 1 THEN text || ' x' WHEN 3 THEN replace(text, ' ', '  ') ELSE text END) AS text_hash
        FROM {entries} WHERE k % 6 < 4""",
    "members": """
        SELECT doc_id AS member_id, location_id, SHA(text) AS sha256, NORMHASH(text) AS text_hash FROM {docs}
        UNION ALL
        SELECT doc_id + 2000000, location_id, SHA(replace(text, ' ', '  ')), NORMHASH(text) FROM {docs} WHERE doc_id % 7 = 0""",
    "jobs": """
        SELECT user_id AS job_id, event_id, ts, event_type AS phase, value, CAST(floor(value) AS BIGINT) AS current,
            CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value * 2) AS BIGINT) END AS total,
            CASE event_id % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'running' WHEN 4 THEN 'retry_wait' ELSE 'cancelled' END AS status
        FROM {events}""",
    "points": "SELECT 'c' || doc_id AS content_id, 'p' || doc_id AS point_id, embedding AS vector, text, doc_id FROM {embeddings} v JOIN {docs} d ON v.vec_id = d.doc_id",
    # the stated query set; the questions are the benchmark's, in turn
    "queries": "SELECT vec_id AS query_id, embedding AS vector, coalesce(text, '') AS question FROM {embeddings} v LEFT JOIN {benchmark} b ON floor(v.vec_id / 50) % 200 = b.item_id WHERE vec_id % 50 = 0",
    "backups": "SELECT 'b' || job_id || '-' || day AS id, min(ts) AS made_at FROM (SELECT job_id, ts, DAYOF(ts) AS day FROM {jobs}) x GROUP BY job_id, day",
    "hits": "SELECT conv_id AS question_id, CAST(turn + 1 AS INTEGER) AS rank, 'c' || (turn % 3) AS content_id, coalesce(text, '') AS text, turn FROM {conversations}",
    "answers": """
        SELECT conv_id, turn, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' [E2] and [E1], [E2]' WHEN 1 THEN ' [E9] [E3]' WHEN 2 THEN ' [E01]' ELSE '' END
            || CASE WHEN conv_id % 9 = 0 THEN ' INSUFFICIENT_EVIDENCE' ELSE '' END AS answer FROM {conversations}""",
}
EXT = "CASE {} % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' WHEN 3 THEN 'pdf' ELSE 'log' END"
SPARK = {
    "TS": "timestamp_seconds({})", "SHA": "sha2({}, 256)", "EXT": EXT, "DAYOF": "date_format({}, 'yyyyMMdd')",
    "NORMHASH": r"sha2(trim(regexp_replace({}, '[ \n\t]+', ' ')), 256)",
}
DUCK = {
    "TS": "make_timestamp(CAST({} AS BIGINT) * 1000000)", "SHA": "sha256({})", "EXT": EXT, "DAYOF": "strftime({}, '%Y%m%d')",
    "NORMHASH": r"sha256(trim(regexp_replace({}, '\s+', ' ', 'g')))",
}
GIVEN = ("documents", "embeddings", "events", "benchmark", "conversations")


def spelled(sql: str, dialect: dict[str, str]) -> str:
    """The SQL with the functions of a dialect in the place of the upper-case names."""
    while m := re.search(rf"\b({'|'.join(dialect)})\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: m.start()] + dialect[m[1]].format(sql[m.end() : end - 1]) + sql[end:]
    return sql


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Derived (or given) tables as DataFrames."""
    done: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in done:
            if name in TABLES:
                sql = TABLES[name]
                done[name] = spark.sql(spelled(sql, SPARK), **{n: get(n) for n in set(re.findall(r"\{(\w+)\}", sql))})
            else:
                done[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return done[name]

    return [get(n) for n in names]


def ctes(*names: str) -> str:
    """The definitions of derived tables as clauses of ``WITH`` for the comparison engine."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in order:
            for n in re.findall(r"\{(\w+)\}", TABLES[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    bodies = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', spelled(TABLES[n], DUCK))})" for n in order]
    return ",\n".join(bodies)
