import hashlib
import re

import pytest
from helpers import DOCS, brute_components, corpus, edited, shingle_set, table, words
from pyspark.sql import functions as F

from folioworks.llm import components, exact_dedup, near_dedup, substring_dedup


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_against_brute_force(spark):
    texts = corpus()
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(fold(t), []).append(i)
    rows = exact_dedup.exact_decisions(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = by[fold(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(fold(texts[r["doc_id"]]).encode()).hexdigest()


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_exact_is_right_with_a_crowded_filter(spark, bits):
    docs = table(spark, corpus())
    got = exact_dedup.exact_dedup(docs, filter_bits=bits).select("doc_id", "keep_id", "kept").collect()
    assert set(got) == set(exact_dedup.exact_decisions(docs).select("doc_id", "keep_id", "kept").collect())


def test_exact_keeps_whole_rows_and_refuses_clashes(spark):
    docs = table(spark, ["a", "A", None, "", "b"])
    assert {r["doc_id"] for r in exact_dedup.keep_one(docs).collect()} == {1, 3, 4}
    assert exact_dedup.keep_one(docs).columns == docs.columns
    with pytest.raises(ValueError, match="kept"):
        exact_dedup.exact_dedup(docs.withColumn("kept", F.lit(1)))


def test_exact_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), (4, "a")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_decisions(docs).collect())
    assert got == [(0, 0, 2, True), (0, 0, 2, True), (0, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup.exact_decisions(docs.limit(0)).count() == 0


def test_exact_is_native(spark):
    plan = exact_dedup.exact_dedup(table(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_against_brute_force(spark, k, percent):
    texts = corpus()
    expected = brute_components(enumerate(texts), k, percent)
    rows = near_dedup.near_groups(table(spark, texts), k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert all(r["n_shingles"] == len(shingle_set(texts[r["doc_id"]], k)) for r in rows)


def test_near_edge_cases(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_dedup.near_groups(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 3)]


def test_near_keeps_one_of_each_group(spark):
    texts = corpus()
    expected = brute_components(enumerate(texts), 5, 80)
    kept = near_dedup.keep_one_of_each(table(spark, texts)).collect()
    assert {r["doc_id"] for r in kept} == {i for i, c in expected.items() if i == c}


def test_near_draws_three_centres_and_the_smallest_id(spark):
    placed = spark.createDataFrame([(i, 10, b, 1, i) for b in range(30) for i in range(200)], "id long, n long, bucket long, score long, component long")
    centres = {tuple(c["id"] for c in r["centres"]) for r in near_dedup.centres_of(placed, 1).collect()}
    assert len(centres) == 1 and len(own := centres.pop()) == 4 and own[0] == 0


@pytest.mark.parametrize(("rounds", "part"), [(1, 16), (2, 48), (1, 256)])
def test_near_finds_links_inside_a_family_below_the_threshold(spark, monkeypatch, rounds, part):
    # about 0.77 similar to each other, with single pairs of 0.85 and more
    monkeypatch.setattr(near_dedup, "SLICE", part)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    base = words(300, 4242, 10**6)
    texts = [edited(base, 5000 + s, 4) for s in range(160)]
    texts += [edited(texts[3 * i], 7000 + i, 2) for i in range(40)]
    expected = brute_components(enumerate(texts), 5, 85)
    assert 20 < sum(i != c for i, c in expected.items()) < 100
    rows = near_dedup.near_groups(table(spark, texts), 5, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(130, 129), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100)}


def brute_substrings(texts, length=50):
    out = {}
    seen = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        hit = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen.get(data[k : k + length], i) < i:
                hit[k : k + length] = b"\1" * length
        for k in range(len(data) - length + 1):
            seen.setdefault(data[k : k + length], i)
        kept = bytes(c for c, h in zip(data, hit, strict=True) if not h)
        out[i] = (len(data), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    texts = corpus() + ["ab" * 300, "ab" * 200 + "c", "x" * 49, "x" * 50, words_around("y")]
    rows = substring_dedup.substring_dedup(table(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute_substrings(texts)


def test_substrings_of_one_large_bucket_are_dealt_again(spark, monkeypatch):
    # one gram with many surroundings: more bytes than a task may search
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 2000)
    held, search = [], substring_dedup.found_by_string
    monkeypatch.setattr(substring_dedup, "found_by_string", lambda hot, length: held.append(hot.count()) or search(hot, length))
    texts = corpus() + [f"{words(6, 600 + i % 90)} one common sentence of all documents {words(6, 800 + i % 80)}" for i in range(200)]
    rows = substring_dedup.substring_dedup(table(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute_substrings(texts)
    assert held and held[0] > 30


def test_substrings_when_every_bucket_is_marked(spark, monkeypatch):
    full = lambda texts, length, bits, chunks: substring_dedup.BitTables(substring_dedup.np.full((1, 8), 255, "u1"))
    monkeypatch.setattr(substring_dedup, "shared_table", full)
    texts = corpus()
    rows = substring_dedup.substring_dedup(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_substrings(texts)


def words_around(c):
    return f"{c * 30} middle {c * 30}"


def test_substrings_kept_bytes_and_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a" * 60), (None, "a" * 60), (2, "b" + "a" * 60), (2, "b" + "a" * 60), (3, "a" * 60)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(docs, with_kept=True).collect())
    assert got == [(0, 0, b"a" * 60), (1, 0, b"a" * 60), (2, 60, b"b"), (2, 60, b"b"), (3, 60, b"")]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_exact_filter_finds_each_repeat_and_few_others(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 19000 AS string) AS text")
    digests = docs.select(exact_dedup.text_digest(F.col("text")).alias("h"), (F.col("doc_id") % 19000 < 1000).alias("repeated"))
    bits = exact_dedup.filter_bits_for(20_000)
    marked = exact_dedup.probe(digests, "h", exact_dedup.repeat_filter(digests, "h", bits), bits)
    found = {(r["repeated"], r["maybe_repeated"]): r["count"] for r in marked.groupBy("repeated", "maybe_repeated").count().collect()}
    assert found[True, True] == 2000 and (True, False) not in found and found[False, True] < 0.05 * 18_000


def test_clashing_columns(spark):
    docs = table(spark, ["a", "A", None, "", "b"])
    odd = docs.withColumns({c: F.lit(7) for c in ("maybe_repeated", "row_part", "filter_bits", "kept", "id", "row", "component_id", "found", "long")})
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {(r["doc_id"], r["kept"], r["row"]) for r in kept.collect()} == {(1, 7, 7), (3, 7, 7), (4, 7, 7)}
    with pytest.raises(ValueError, match="maybe_repeated"):
        exact_dedup.exact_dedup(docs.withColumn("maybe_repeated", F.lit(1)))
    kept = near_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert set(near_dedup.near_groups(odd).columns) == {"doc_id", "n_shingles", "component_id"}
    assert substring_dedup.substring_dedup(odd).count() == 5
