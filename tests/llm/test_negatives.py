"""Hard negatives against all pairs, and packed products against plain ones."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import queries
from folioworks.llm.hard_negatives import Fields, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, scale=256):
    """Each id's smallest row, all anchors against all others."""
    one = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in whole.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit[:3])]
    return sorted(out)


def mined(df, **more):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in columns) for r in hard_negatives(df, is_anchor=F.col("id") % 50 == 0, **more).collect())


def near_each_other(rng, n, size, labels, spread=0.3):
    centre = [rng.uniform(0.2, 1) for _ in range(size)]
    return [(i * 5, [c + rng.uniform(-spread, spread) for c in centre], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("scale", [256, 40_000, 5e8])
def test_all_pairs(spark, scale):
    rng = random.Random(int(scale))
    rows = near_each_other(rng, 900, 5, 4)
    expected = brute(rows, lambda i: i % 50 == 0, scale)
    assert len(expected) > 500 and mined(spark.createDataFrame(rows, SCHEMA), scale=scale) == expected


def test_ties_repeats_and_odd_rows(spark):
    rng = random.Random(5)
    rows = near_each_other(rng, 300, 4, 3)
    rows += [(10_000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(600)]  # one vector very often
    rows += [rows[0], rows[0], (rows[1][0], [0.1, 0.9, 0.2, 0.3], 1)]
    rows += [(None, [0.5] * 4, 1), (50_001, None, 1), (50_002, [0.5] * 4, None), (50_003, [0.5, None, 0.5, 0.5], 1), (50_004, [0.5, float("nan"), 0.5, 0.5], 1), (50_005, [float("inf")] * 4, 1)]
    rows += [(50_050, [], 1), (50_100, [0.9], 2), (50_150, [0.5, 0.5, 0.5, 0.5], 77)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i % 50 == 0)


def test_empty_and_clashing_columns(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = near_each_other(random.Random(2), 120, 3, 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "vector": F.lit(1), "grp": F.lit(2), "positives": F.lit(None).cast("string")})
    assert mined(df) == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("largest", [1, 300, 2**15, 2**20, 2**40])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    for rows, anchors, size in ((1, 1, 3), (7, 4, 64), (385, 33, 64), (50, 9, 1)):
        a, c = rng.integers(-largest, largest + 1, (anchors, size)), rng.integers(-largest, largest + 1, (rows, size))
        a[0], c[0] = -largest, largest
        plain = a.astype(object) @ c.astype(object).T
        longest = float(max((x.astype(object) ** 2).sum(axis=1).max() for x in (a, c)))
        fields = Fields.of(size, 1.0, longest)
        assert fields.number > 1
        got = fields.scores(fields.components(a.astype("<f8").tobytes(), anchors), fields.components(c.astype("<f8").tobytes(), rows))
        assert (got == plain).all()


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.sql(queries.ORACLES["op11_hard_negatives"])
    got = [tuple(r[c] for c in rel.columns) for r in queries.op11_hard_negatives(spark, sf).collect()]
    assert sorted(got) == sorted(rel.fetchall()) and got
