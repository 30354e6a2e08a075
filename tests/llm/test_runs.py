"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import corpus, table

from folioworks.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, shortest=6, exponent=4):
    """``start, length, period`` of all runs, from the stretches of equal words q apart."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in drop]


def planted(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p = rng.randrange(max(1, n)), rng.randrange(1, 14)
        for i in range(a, min(n, a + rng.randrange(90))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_all_runs_are_found(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = planted(rng, rng.randrange(140), letters)
        start, end, period = periodic_runs.runs_of(np.array(words, np.int64), 6, 4)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(words)


def test_order_statistics():
    values = np.random.default_rng(3).permutation(300).astype(np.int32)
    tree = periodic_runs.WaveletTree(values)
    low, high = np.array([0, 17, 250, 40]), np.array([300, 60, 251, 41])
    for y in (0, 5, 150, 299):
        assert tree.smaller(low, high, np.full(4, y)).tolist() == [(values[a:b] < y).sum() for a, b in zip(low, high, strict=True)]
    assert tree.nth(low, high, np.array([299, 20, 0, 0])).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, (299, 20, 0, 0), strict=True)]


def test_texts_do_not_match_each_other(spark):
    one = "a b c d e f g h " * 3
    rows = periodic_runs.find_runs(table(spark, [one, one, one + one, None, "", " \t", "x " * 9, "x " * 5, *corpus()])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [len(by[i]["runs"]) for i in range(8)] == [0, 0, 1, 0, 0, 0, 1, 0]
    assert by[2]["collapsed"] == "a b c d e f g h" and by[6]["collapsed"] == "x" and by[3]["collapsed"] == by[5]["collapsed"] == ""
    assert tuple(by[6]["runs"][0]) == (0, 9, 1) and by[7]["n_words"] == 5


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic_runs.find_runs(empty).count() == 0
    odd = spark.createDataFrame([(None, "y " * 7, "a"), (4, "y " * 7, "a"), (4, "y " * 7, "a"), (5, None, None)], "doc_id long, text string, runs string")
    assert sorted((r["doc_id"] or 0, len(r["runs"])) for r in periodic_runs.find_runs(odd).collect()) == [(0, 1), (4, 1), (4, 1), (5, 0)]
    named = spark.createDataFrame([("k", "y " * 7)], "doc_id string, text string")
    assert periodic_runs.find_runs(named).collect()[0]["doc_id"] == "k"
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs(odd, exponent=3)


def test_a_very_long_text(spark):
    text = "start " + "one two three " * 60_000 + "end"
    row = periodic_runs.find_runs(table(spark, [text])).collect()[0]
    assert tuple(row["runs"][0]) == (1, 180_000, 3) and row["collapsed"] == "start one two three end"


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()
