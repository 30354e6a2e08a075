"""Search by index against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators import search, vector_index


def gathered(n, groups, size=8, spread=0.05, seed=1):
    """Points around a few directions."""
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    return [[x + rng.gauss(0, spread) for x in heads[i % groups]] for i in range(n)]


def similarity(a, b, distance):
    dot, x, y = sum(p * q for p, q in zip(a, b, strict=True)), math.sqrt(sum(p * p for p in a)), math.sqrt(sum(q * q for q in b))
    if distance == "dot":
        return dot
    return -math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True))) if distance == "euclid" else dot / (x * y) if x * y else 0.0


def brute(points, queries, k, distance, threshold=None, fits=lambda p, q: True):
    out = []
    for q, (qv, qt) in enumerate(queries):
        scored = sorted((-round(similarity(v, qv, distance), 6), i) for i, (v, t) in enumerate(points) if fits(t, qt))
        fit = [(q, i, -s) for s, i in scored if threshold is None or -s >= threshold]
        out += fit[:k]
    return sorted(out)


def frames(spark, points, queries):
    p = spark.createDataFrame([(i, [*map(float, v)], t) for i, (v, t) in enumerate(points)], "point_id long, vector array<double>, terms array<string>")
    return p, spark.createDataFrame([(i, [*map(float, v)], t) for i, (v, t) in enumerate(queries)], "query_id long, vector array<double>, terms array<string>")


def rows(df):
    return sorted((r["query_id"], r["point_id"], round(r["score"], 6)) for r in df.collect())


def close(got, expected):
    return [g[:2] for g in got] == [e[:2] for e in expected] and all(abs(g[2] - e[2]) < 2e-6 for g, e in zip(got, expected, strict=True))


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
def test_vector_leg(spark, distance, monkeypatch):
    monkeypatch.setattr(vector_index, "PER_CENTRE", 60)
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    points = [(v, []) for v in gathered(700, 9)] + [([0.3] * 8, [])] * 90 + [([0.0] * 8, [])]
    queries = [(points[i][0], []) for i in (0, 5, 13, 650, 701, 790)]
    p, q = frames(spark, points, queries)
    assert close(rows(search.vector_leg(p, q, 7, distance)), brute(points, queries, 7, distance))


def test_threshold_and_few_points(spark):
    points = [([1, 0, 0, 0], []), ([0, 1, 0, 0], [])]
    queries = [([1, 0, 0, 0], [])]
    p, q = frames(spark, points, queries)
    assert rows(search.vector_leg(p, q, 12, threshold=0.5)) == [(0, 0, 1.0)]
    assert len(rows(search.vector_leg(p, q, 12))) == 2
    assert rows(search.vector_leg(p.filter("false"), q, 12)) == [] and rows(search.vector_leg(p, q.filter("false"), 12)) == []


def test_keyword_leg(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PER_CENTRE", 80)
    rng = random.Random(3)
    names = [f"t{i}" for i in range(40)]
    points = [(v, [*rng.sample(names, 3), "the"] if i % 5 else []) for i, v in enumerate(gathered(600, 7, seed=4))]
    queries = [(points[i][0], t) for i, t in ((0, ["t1", "the"]), (3, ["t2"]), (77, ["never"]), (80, []), (9, ["t5", "t7", "t9"]))]
    p, q = frames(spark, points, queries)
    assert close(rows(search.keyword_leg(p, q, 9)), brute(points, queries, 9, "cosine", fits=lambda t, own: bool(set(t) & set(own))))


def test_allow_set_and_fusion(spark):
    points = [([1.0, 0, 0, 0], ["cats"]), ([1.0, 0, 0, 0], ["dogs"]), ([0.2, 1, 0, 0], ["albert"])]
    queries = [([1.0, 0, 0, 0], ["albert", "job"]), ([1, 0, 0, 0], [])]
    p, q = frames(spark, points, queries)
    p = p.withColumn("content_id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("a")), (F.col("point_id") + 1).cast("int")))
    ranks = lambda df: [(r["query_id"], r["point_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert ranks(search.hybrid(p, q, 3)) == [(0, 2), (0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    only = spark.createDataFrame([("b",)], "content_id string")
    assert ranks(search.hybrid(p, q, 3, allowed=only)) == [(0, 1), (1, 1)]
    assert ranks(search.hybrid(p, q, 3, allowed=only.filter("false"))) == []


def work(index, queries, k):
    found = vector_index.search_index(index, queries, k, with_work=True)
    return found.agg(F.sum("scored")).first()[0] or 0


def test_few_pairs_are_scored(spark, monkeypatch):
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS point_id", "embedding AS vector")
    queries = points.filter("point_id % 50 = 0").withColumnRenamed("point_id", "query_id")
    pairs = points.count() * queries.count()
    assert work(vector_index.build_index(points), queries, 12) < pairs / 10
    # and where points gather, most blocks are not visited at all
    monkeypatch.setattr(vector_index, "PER_CENTRE", 30)
    near = spark.createDataFrame([(i, v) for i, v in enumerate(gathered(1200, 12))], "point_id long, vector array<double>")
    index = vector_index.build_index(near)
    asked = near.filter("point_id < 24").withColumnRenamed("point_id", "query_id")
    blocks = vector_index.search_index(index, asked, 5, with_work=True).filter("scored IS NOT NULL").count()
    assert len(index.centres) == 40 and blocks < 24 * 40 / 2


def test_paths_of_hits(spark):
    entries = spark.createDataFrame(
        [("c", "e2", "l", "/b", "indexed", 2), ("c", "e1", "l", "/a", "missing", 1), ("d", "e3", "l", "/d", "gone", 1), ("x", "e4", "l", "/x", "indexed", 1)],
        "content_id string, entry_id string, location_id string, display_path string, state string, created_at int",
    )
    first = {r["content_id"]: r for r in search.resolved_paths(entries).withColumn("a", search.availability(F.col("primary.state"))).collect()}
    assert (first["c"]["primary"]["entry_id"], first["c"]["n_paths"], first["c"]["a"], first["d"]["a"]) == ("e1", 2, "missing", "historical")
    hits = spark.createDataFrame([("c",), ("c",), ("d",)], "content_id string")
    assert sorted((r["entry_id"], r["is_primary"]) for r in search.path_rows(hits, entries).collect()) == [("e1", True), ("e2", False), ("e3", True)]
