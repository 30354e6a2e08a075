from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioworks.operators import catalog, rag, reports, search

ENTRY = "location_id string, relative_path string, sha256 string, text_hash string"


@pytest.mark.parametrize(
    ("source", "target", "action", "reason", "path"),
    [
        (("a", "H", "T"), [("a", "H", "T")], "already_present", "exact", "a"),
        (("a", "H", "T"), [("a", "X", "T")], "conflict", "path_conflict", "a"),
        (("a", "H", "T"), [("z", "H", "T"), ("b", "H", "T")], "manual_review", "renamed", "b"),
        (("a", "H", "T"), [("b", "X", "T")], "manual_review", "text_equivalent", "b"),
        (("a", "H", "T"), [], "copy", "missing", None),
        (("a", "H", "T"), [("a", "X", "Y"), ("b", "H", "T")], "conflict", "path_conflict", "a"),
    ],
)
def test_compare(spark, source, target, action, reason, path):
    s = spark.createDataFrame([("L", *source)], ENTRY)
    t = spark.createDataFrame([("L", *x) for x in target], ENTRY)
    items = reports.compare_locations(s, t)
    (row,) = items.collect()
    assert (row["action"], row["reason"], row["target_path"]) == (action, reason, path)
    assert reports.comparison_summary(items).first()["covered_percent"] == (100.0 if action in ("already_present", "manual_review") else 0.0)


def test_duplicates(spark):
    rows = [(1, "a", "t"), (2, "a", "t"), (3, "b", "u"), (4, "c", "u")]
    got = {tuple(r) for r in reports.duplicate_groups(spark.createDataFrame(rows, "id int, sha256 string, text_hash string")).collect()}
    assert got == {("exact", "a", 2), ("text", "u", 2)}


def test_retention(spark):
    def kept(days, *counts):
        df = spark.createDataFrame([(k, datetime.fromisoformat(v)) for k, v in days.items()], "id string, made_at timestamp")
        keep = reports.retained(df, *counts)
        return {r["id"] for r in keep.collect()}, [r["id"] for r in reports.pruned(df, keep).collect()]

    assert kept({"a": "2026-08-06 02:00", "b": "2026-08-06 09:00", "c": "2026-08-05 02:00"}, 1, 0, 0) == ({"b"}, ["c", "a"])
    four = {"a": "2026-08-06", "b": "2026-07-28", "c": "2026-06-15", "d": "2026-01-01"}
    keep, gone = kept(four, 1, 2, 2)
    assert {"a", "b"} <= keep and "d" not in keep and gone[0] == "d"


def test_percentiles(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(1, 31)], "k string, v double")
    row = reports.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row["p50"], row["p95"], row["largest"], row["mean"]) == (16.0, 29.0, 30.0, 15.5)


def test_guard_marks_nothing_missing_for_unreachable_roots(spark):
    loc = spark.createDataFrame([("ok", "s"), ("gone", "s"), ("other", "s"), ("new", None)], "location_id string, sentinel_id string")
    seen = spark.createDataFrame([("ok", "s"), ("gone", None), ("other", "t"), ("new", "n")], "location_id string, observed_sentinel string")
    got = {(r["location_id"], r["sentinel_id"]) for r in catalog.scan_ready(loc, seen).collect()}
    assert got == {("ok", "s"), ("new", "n")}


def evidence(spark, hits, budget, per_content, most):
    rows = [("q", i + 1, content, " ".join(["w"] * n)) for i, (n, content) in enumerate(hits)]
    df = spark.createDataFrame(rows, "question_id string, rank int, content_id string, text string")
    return sorted((r["alias"], r["rank"], r["tokens"]) for r in rag.select_evidence(df, budget, per_content, most).collect())


def test_evidence(spark):
    assert evidence(spark, [(3, "c1"), (3, "c2")], 100, 3, 10) == [("E1", 1, 3), ("E2", 2, 3)]
    assert [r for _, r, _ in evidence(spark, [(1, "c1"), (1, "c1"), (1, "c1"), (1, "c2")], 100, 2, 10)] == [1, 2, 4]
    assert evidence(spark, [(10, "a"), (50, "b"), (3, "c")], 15, 3, 10) == [("E1", 1, 10), ("E2", 3, 3)]
    assert evidence(spark, [(100, "a")], 20, 3, 10) == [("E1", 1, 20)]
    assert len(evidence(spark, [(1, str(i)) for i in range(20)], 1000, 3, 5)) == 5


def test_citations(spark):
    rows = [("b [E2] a [E1] [E2]",), ("x [E9] y [E1]",), ("none",), ("[E01]",)]
    df = spark.createDataFrame(rows, "answer string").withColumn("aliases", F.array(F.lit("E1"), F.lit("E2")))
    got = [(r["citations"], r["rewritten"], len(r["warnings"])) for r in rag.map_citations(df).collect()]
    assert got == [(["E2", "E1"], "b [1] a [2] [1]", 0), (["E1"], "x  y [1]", 1), ([], "none", 0), ([], "", 1)]


def test_policy(spark):
    q = [("local", False, True, False), ("off", True, False, True), ("denied", True, True, True), ("ask", True, True, False), ("go", True, True, True)]
    questions = spark.createDataFrame(q, "question_id string, external boolean, external_enabled boolean, acknowledged boolean")
    policies = spark.createDataFrame([("denied", "deny"), ("denied", "allow"), ("ask", "allow"), ("go", "allow"), ("local", "deny")], "question_id string, policy string")
    got = {r["question_id"]: (r["decision"], r["denied_sources"]) for r in rag.external_decision(questions, policies).collect()}
    assert got == {"local": ("allowed", 0), "off": ("denied", 0), "denied": ("denied", 1), "ask": ("confirmation_required", 0), "go": ("allowed", 0)}


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id string, content_id string, vector array<float>, terms array<string>")


def asked(spark, vector, terms):
    return spark.createDataFrame([("q", vector, terms)], "query_id string, vector array<float>, terms array<string>")


def test_hybrid_search(spark):
    p = points(spark, [("a", "a", [1.0, 0.0, 0.0, 0.0], ["renewal", "clause"]), ("b", "b", [0.0, 1.0, 0.0, 0.0], ["about", "cats"])])
    assert [r["point_id"] for r in search.hybrid(p, asked(spark, [1.0, 0.0, 0.0, 0.0], []), 5, threshold=0.5).collect()] == ["a"]
    p = points(spark, [("far", "a", [0.2, 1.0, 0.0, 0.0], ["albert", "worked"]), ("near", "b", [1.0, 0.0, 0.0, 0.0], ["other"])])
    order = lambda terms: [r["point_id"] for r in search.hybrid(p, asked(spark, [1.0, 0.0, 0.0, 0.0], terms), 5).orderBy("rank").collect()]
    assert order(["albert", "last", "job"])[0] == "far"
    assert order([])[0] == "near"
    allowed = spark.createDataFrame([("a",)], "content_id string")
    assert [r["point_id"] for r in search.hybrid(p, asked(spark, [1.0, 0.0, 0.0, 0.0], []), 5, allowed=allowed).collect()] == ["far"]
    assert search.hybrid(p, asked(spark, [1.0, 0.0, 0.0, 0.0], []), 5, allowed=allowed.limit(0)).count() == 0


def test_overlapping_roots(spark):
    rows = [("a", "p", True, "/data/"), ("b", "p", True, "/data/x/"), ("c", "p", True, "/database/"), ("d", "w", True, "/data/"), ("e", "p", False, "/data/x/y/")]
    df = spark.createDataFrame(rows, "location_id string, family string, enabled boolean, root string")
    assert [tuple(r) for r in reports.overlapping_roots(df, F.col("root")).collect()] == [("a", "b")]
