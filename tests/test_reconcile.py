from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioworks.operators.reconcile import apply_plan, reconcile

T0 = datetime(2026, 1, 1)
T1 = T0 + timedelta(minutes=1)
CATALOG = "entry_id string, location_id string, relative_path string, state string, size bigint, mtime timestamp, sha256 string, missing_at timestamp"
OBSERVED = "location_id string, relative_path string, size bigint, mtime timestamp, sha256 string"


def cat(path, sha, state="indexed", ident=None, at=None):
    return (ident or f"id:{path}", "L", path, state, 1, T0, sha, at)


def obs(path, sha, mtime=T0):
    return ("L", path, 1, mtime, sha)


CASES = {
    "added": ([], [obs("a.txt", "A")], {"added": 1}),
    "unchanged": ([cat("a.txt", "A")], [obs("a.txt", "A")], {"unchanged": 1}),
    "metadata": ([cat("a.txt", "A")], [obs("a.txt", "A", T1)], {"metadata": 1}),
    "changed": ([cat("a.txt", "OLD")], [obs("a.txt", "NEW")], {"changed": 1}),
    "null hash is a change": ([cat("a.txt", None)], [obs("a.txt", "NEW")], {"changed": 1}),
    "missing": ([cat("a.txt", "A")], [], {"missing": 1}),
    "missing stays missing": ([cat("a.txt", "A", "missing")], [], {}),
    "moved": ([cat("old/name.txt", "A")], [obs("new/name.txt", "A")], {"moved": 1}),
    "restored": ([cat("a.txt", "A", "missing")], [obs("a.txt", "A")], {"restored": 1}),
    "moved back": ([cat("gone.txt", "A", "missing")], [obs("here.txt", "A")], {"moved": 1}),
    "copy is added": ([cat("a.txt", "A")], [obs("a.txt", "A"), obs("copy.txt", "A")], {"unchanged": 1, "added": 1}),
    "one to one": ([cat("a.txt", "D"), cat("b.txt", "D")], [obs("c.txt", "D")], {"moved": 1, "missing": 1}),
}


@pytest.mark.parametrize("case", CASES)
def test_kinds(spark, case):
    old, new, kinds = CASES[case]
    plan = reconcile(spark.createDataFrame(old, CATALOG), spark.createDataFrame(new, OBSERVED))
    assert {r["kind"]: r["count"] for r in plan.groupBy("kind").count().collect()} == kinds


def test_moves_take_the_last_path_and_keep_the_state(spark):
    old = [cat("a.txt", "D"), cat("b.txt", "D", "failed")]
    (row,) = reconcile(spark.createDataFrame(old, CATALOG), spark.createDataFrame([obs("c.txt", "D")], OBSERVED)).filter("kind = 'moved'").collect()
    assert (row["entry_id"], row["state"], row["clear_missing"]) == ("id:b.txt", "failed", False)


def test_apply(spark):
    old = spark.createDataFrame([cat("a.txt", "A"), cat("b.txt", "B"), cat("c.txt", "C", "missing", at=T0), cat("x.txt", "X", "missing", at=T0)], CATALOG)
    new = spark.createDataFrame([obs("a.txt", "A"), obs("c.txt", "C"), obs("n.txt", "N")], OBSERVED)
    rows = apply_plan(old, reconcile(old, new), F.lit(T1), F.concat(F.lit("new:"), "relative_path")).collect()
    got = {r["relative_path"]: (r["entry_id"], r["state"], r["missing_at"]) for r in rows}
    assert got == {
        "a.txt": ("id:a.txt", "indexed", None),
        "b.txt": ("id:b.txt", "missing", T1),
        "c.txt": ("id:c.txt", "discovered", None),
        "n.txt": ("new:n.txt", "discovered", None),
        "x.txt": ("id:x.txt", "missing", T0),
    }
