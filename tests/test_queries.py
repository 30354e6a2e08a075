import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One of each module; the driver compares all of them.
NAMES = ["a3_u2_duplicate_report", "j4_j5_reconcile", "j7_r11_compare_locations", "r1_r2_w3_chunks", "r4_r4b_t3_hybrid_search", "r5_w10_evidence", "f6_expand_terms", "w8_monotone_progress"]


def plain(rows, columns):
    return sorted(repr(tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in (r[c] for c in columns))) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    columns = sorted(rel.columns)
    mine = entry.queries()[name](spark, SF).toArrow()
    assert sorted(mine.column_names) == columns
    theirs = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert plain(mine.to_pylist(), columns) == plain(theirs, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_paging_is_a_top_k(spark):
    plan = entry.queries()["t1_document_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_columns_are_pruned(spark):
    plan = entry.queries()["a15_distinct_contents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "n_chars" not in plan
