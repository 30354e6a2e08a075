"""Language-model scores against counts in dictionaries, and the sequences below them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, table
from pyspark.sql import functions as F

from folioworks.llm import lm_scoring, queries
from folioworks.llm.elias_fano import EliasFano, mapped

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Plain:
    """The same model from n-grams in a dictionary; ``""`` starts a text, None ends it."""

    def __init__(self, texts, order=2, prior=500.0):
        self.order, self.prior, self.counts = order, prior, Counter()
        for text in texts:
            own = ["", *tokens_of(text)]
            self.counts.update(tuple(own[i : i + k]) for k in range(1, order + 1) for i in range(len(own) - k + 1))
        self.n = sum(c for g, c in self.counts.items() if len(g) == 1 and g != ("",))
        self.v = sum(1 for g in self.counts if len(g) == 1 and g != ("",))

    def p(self, history, word):
        out = (self.counts[(word,)] + 1) / (self.n + self.v + 1)
        for k in range(1, min(self.order - 1, len(history)) + 1):
            h = tuple(history[-k:])
            out = (self.counts[(*h, word)] + self.prior * out) / (self.counts[h] + self.prior)
        return out

    def scores(self, text):
        own = ["", *tokens_of(text)]
        base = sum(math.log10((self.counts[(w,)] + 1) / (self.n + self.v + 1)) for w in own[1:])
        return len(own) - 1, sum(self.counts[(w,)] > 0 for w in own[1:]), base, sum(math.log10(self.p(own[:i], own[i])) for i in range(1, len(own)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARE", 2500)
    docs = dict(enumerate(corpus()))
    model = Plain([t for i, t in docs.items() if i % 3], order)
    got = lm_scoring.score_texts(table(spark, docs.values()), F.col("doc_id") % 3 != 0, order).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, base, score = model.scores(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, model.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, abs=3e-4 * n)


def test_probabilities_add_up():
    model = Plain([t for t in corpus() if t][:8], 3)
    words = [g[0] for g in model.counts if len(g) == 1 and g != ("",)]
    for history in (["", "w1"], words[:2], ["never", "seen"]):
        assert sum(model.p(history, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (3, None, 1), (3, "A b", 1), (3, "A b", 1), (4, "", 1)], "doc_id long, text string, batch long")
    rows = lm_scoring.score_texts(odd, F.col("doc_id") == 3).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in rows) == [(0, 3, 3), (3, 1, 1), (3, 3, 3), (3, 3, 3), (4, 1, 1)]
    untrained = lm_scoring.score_texts(odd, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in untrained} == {(0, 0, 0.0, 0.0)}


def test_words_are_hashed_alike_in_any_slice(monkeypatch):
    texts = [t.encode() for t in corpus() if t] + [b"x" * 5000 + b" Y\x0bz", b"", b"a"]
    hashes, counts = lm_scoring.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == counts.sum()
    monkeypatch.setattr(lm_scoring, "SLICE", 40)
    again, same = lm_scoring.word_hashes(texts)
    assert (again == hashes).all() and (same == counts).all()
    names = [w.decode().translate({i: i + 32 for i in range(65, 91)}) for t in texts for w in t.split()]
    assert len(set(names)) == len(np.unique(hashes)) == len(set(zip(names, hashes.tolist(), strict=True)))


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 2**64 - 1), (5, 10), (1000, 1000), (1000, 2**40), (3000, 2**64 - 1), (200, 3)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    own = EliasFano(mapped(EliasFano.arrays(values, "x")), "x")
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (own.successor(asked) == np.searchsorted(values, asked)).all()
    assert (own[np.arange(n)] == values).all()
    assert ((own.find(asked) >= 0) == np.isin(asked, values)).all()


def test_the_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    model = Plain([t for i, t in docs.items() if not out[i]])
    got = queries.op12_lm_scores(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, base, score = model.scores(docs[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], n, known, model.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, abs=3e-4 * n)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
