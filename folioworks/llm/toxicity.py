"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words, stemmed by cutting them to ``STEM`` letters.  The
classifier is fitted on a bounded sample of labelled rows (``max_examples``,
half of each label at most, distinct texts chosen by a hash).  Every term of the
examples is indexed; their document frequencies are counted over all documents.
A term weighs ``(1 + log tf) * idf * relevance``:
the last factor, log2(2 + toxic / max(1, other)) of the examples that hold the
term, is the supervised term weighting known as tf.idf.rf.  Vectors have unit
length over the indexed terms.

The inverted index keeps the postings of frequent terms in blocks of ``BLOCK``
examples, with the largest weight of each term in each block; the short lists
of the other terms are plain.  A query adds up its short lists, then the block
maxima into an upper bound for every block, scores the blocks of the highest
bounds, and then those others whose bound reaches the k-th best cosine found, so
the neighbours are exact.  Queries go through the blocks together.

The vote of the ``k`` nearest, weighted by their cosine against a share of the
prior, is calibrated by an isotonic fit on the examples' votes without
themselves.  The nearest examples are returned as evidence.

Null and empty texts have no terms: they get the score of an empty vote.
Repeated rows score alike.  Labels that are null are not used; of several
labels of one id the highest holds.  Without both labels in the sample every
score is the prior.  Language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import partitions, small_batches, written
from .worker import release

MAX_EXAMPLES, BLOCK, NEAREST = 6000, 64, 15
#: A term is frequent if one example in so many has it.
FREQUENT = 16
#: Blocks that a query scores before it compares bounds, and queries that are scored together.
FIRST, TOGETHER = 12, 64
STEM = 5
TERMS = re.compile(rf"(\w{{1,{STEM}}})\w*")
#: Terms whose counts travel in one row.
CHUNK = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def examples_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int) -> DataFrame:
    """Written ``id, text, y`` of at most ``max_examples`` labelled rows: distinct texts, half of each label at most."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    spread = F.xxhash64(F.col(id_col), F.lit("example"))
    drawn = [marked.filter(F.col("y") == y).orderBy(spread, id_col).limit(max_examples // 2) for y in (0, 1)]
    # max_examples rows of an id and a label
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, id_col)
    rows = rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(id_col).cast("long").alias("id"), F.first("text").alias("text"), F.max("y").alias("y"))
    return written(rows.select("id", "text", "y"), "examples")


def terms_of(text: str) -> list[str]:
    """Runs of letters and digits, cut to stems."""
    return TERMS.findall(text.lower().replace("_", " "))


class Vocabulary:
    """Terms to their numbers."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        self.number = dict(zip(terms, range(self.size), strict=True))

    def present(self, text: str) -> np.ndarray:
        """The numbers of the text's known terms."""
        found = set(terms_of(text))
        own = np.fromiter(map(self.number.get, found, repeat(self.size)), np.int32, len(found))
        return own[own < self.size]

    def numbers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the text's known terms and how often each occurs."""
        found = Counter(terms_of(text))
        own = np.fromiter(map(self.number.get, found, repeat(self.size)), np.int32, len(found))
        known = own < self.size
        return own[known], np.fromiter(found.values(), np.int32, len(found))[known]


def vocabulary_of(examples: DataFrame) -> Vocabulary:
    """All terms of the examples."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {t for text in batch.column(0) for t in terms_of(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["term"])

    # as many rows as the bounded examples have terms
    rows = examples.select("text").mapInArrow(terms, "term string").distinct().toArrow()
    return Vocabulary(sorted(rows["term"].to_pylist()))


def frequencies(texts: DataFrame, vocabulary: Broadcast, size: int) -> tuple[int, np.ndarray]:
    """Rows of ``texts(text)``, and rows that hold each of the ``size`` terms.

    A task sends its counts packed in chunks of terms; chunks are added up in tasks.
    """
    ddl = "chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            held = [vocabulary.value.present(text.as_py()) for text in batch.column(0)]
            n += len(held)
            if held:
                df += np.bincount(np.concatenate(held), minlength=size)
        chunks = [np.array([n]), *(df[i : i + CHUNK] for i in range(0, size, CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(chunks) - 1), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in chunks], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["chunk", "counts"])

    packed = texts.mapInArrow(count, ddl).repartition(min(partitions(texts.sparkSession), -(-size // CHUNK) + 1), "chunk")
    found = {r["chunk"]: np.frombuffer(r["counts"], "<i8") for r in packed.mapInArrow(add, ddl).collect()}  # one number a term
    rows = int(found.pop(-1)[0]) if found else 0
    return rows, np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(size, np.int64)


def spread_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts``, one range after the other."""
    if not len(sizes):
        return np.zeros(0, np.int32)
    steps = np.ones(int(sizes.sum()), np.int32)
    heads = np.cumsum(sizes)[:-1]
    steps[0] = starts[0]
    steps[heads] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(steps, dtype=np.int32)


class BlockMaxIndex:
    """Unit vectors of labelled examples as postings in blocks, with each frequent term's largest weight in each block."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, names: np.ndarray, labels: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], prior: float, k: int) -> None:
        self.vocabulary, self.prior, self.k = vocabulary, prior, k
        size, terms = vocabulary.size, np.concatenate([t for t, _ in counts])
        toxic = np.repeat(labels, [len(t) for t, _ in counts])
        a, b = (np.bincount(terms[toxic == y], minlength=size) for y in (1, 0))
        self.weight = idf * np.log2(2 + a / np.maximum(1, b))
        vectors = [self.unit(*c) for c in counts]
        # alike examples share blocks: by the common term that they repeat most, then by label
        tops = [int(t[np.argmax(c * idf[t] * (idf[t] < np.log(8)))]) if len(t) else -1 for t, c in counts]
        order = np.lexsort((names, labels, tops))
        self.names, self.labels = names[order], labels[order].astype(np.float64)
        terms, weights = (np.concatenate([vectors[i][x] for i in order]) for x in (0, 1))
        own = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        # frequent terms: a row of weights for each block; the others: lists, one term after the other
        many = FREQUENT * (a + b) >= len(order)
        self.frequent = np.where(many, np.cumsum(many) - 1, -1)
        self.blocks = -(-len(order) // BLOCK)
        self.rows = np.zeros((self.blocks, int(many.sum()), BLOCK), np.float32)
        dense = many[terms]
        self.rows[own[dense] // BLOCK, self.frequent[terms[dense]], own[dense] % BLOCK] = weights[dense]
        self.most = np.ascontiguousarray(self.rows.max(axis=2).T)  # term, block
        terms, own, weights = terms[~dense], own[~dense], weights[~dense]
        by = np.lexsort((own, terms))
        self.own, self.posted = own[by].astype(np.int32), weights[by].astype(np.float32)
        self.start = np.searchsorted(terms[by], np.arange(size + 1))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt(weights @ weights)
        return (terms, weights / norm) if norm > 0 else (terms[:0], weights[:0])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query's terms and counts: cosines and places of the k nearest examples with a positive cosine, by falling cosine, then place."""
        scores = np.zeros((len(queries), self.blocks, BLOCK))
        frequent = np.zeros((len(queries), len(self.most)), np.float32)
        for i, (terms, counts) in enumerate(queries):
            terms, weights = self.unit(terms, counts)
            row = self.frequent[terms]
            short = row < 0
            frequent[i, row[~short]] = weights[~short]
            starts = self.start[terms[short]]
            sizes = self.start[terms[short] + 1] - starts
            places = spread_out(starts, sizes)
            if len(places):
                scores[i] = np.bincount(self.own[places], self.posted[places] * np.repeat(weights[short], sizes), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bounds = scores.max(axis=2) + frequent @ self.most
        flat, every = scores.reshape(len(queries), -1), np.arange(len(queries))

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                at = np.flatnonzero(wanted[:, b])
                scores[at, b] += frequent[at] @ self.rows[b]
            if skip is not None:
                flat[every, skip] = 0

        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        visit(first)
        seen = np.where(first[:, :, None], scores, 0).reshape(flat.shape)
        least = np.partition(seen, -self.k, axis=1)[:, -self.k] if flat.shape[1] >= self.k else np.zeros(len(queries))
        rest = ~first & (bounds > 0) & (bounds >= least[:, None] - 1e-5)  # sums of 32-bit weights
        visit(rest)
        scores[~(first | rest)] = 0  # cannot be among the nearest
        out = []
        for own in flat:
            top = np.flatnonzero(own > 1e-9)
            if len(top) > self.k:
                top = top[own[top] >= np.partition(own[top], -self.k)[-self.k]]
            top = top[np.lexsort((top, -own[top]))][: self.k]
            out.append((own[top], top))
        return out

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> float:
        """The neighbours' labels weighted by cosine; half a neighbour votes for the prior."""
        cosines, places = near
        return float((cosines @ self.labels[places] + 0.5 * self.prior) / (cosines.sum() + 0.5))


class Calibration:
    """Isotonic fit of labels on votes, at a given share of toxic rows."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, share: float) -> None:
        order = np.argsort(votes, kind="stable")
        have = labels.mean()
        weight = np.where(labels > 0, share / have, (1 - share) / (1 - have))
        pools: list[list[float]] = []  # weight, weighted label, lowest and highest vote
        for i in order:
            pools.append([weight[i], weight[i] * labels[i], votes[i], votes[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, s, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2], high]
        self.votes = [v for p in pools for v in (p[2], p[3])]
        self.rates = [p[1] / p[0] for p in pools for _ in range(2)]

    def score(self, vote: float) -> float:
        """Between 0 and 1; a thousandth of the vote keeps the order inside flat pieces."""
        return 0.999 * float(np.interp(vote, self.votes, self.rates)) + 0.001 * vote


class Model:
    """A fitted index as a broadcast (its size is bounded by the examples) with its calibration; without both labels the prior alone."""

    def __init__(self, prior: float, index: Broadcast | None = None, calibration: Calibration | None = None) -> None:
        self.prior, self.index, self.calibration = prior, index, calibration


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEAREST) -> Model:
    """The model of at most ``max_examples`` labelled rows outside the held-out third."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()["p"]
    prior = usable if usable is not None else 0.0
    examples = examples_of(docs, labels, id_col, text_col, label_col, max_examples)
    if {r["y"] for r in examples.select("y").distinct().collect()} != {0, 1}:
        return Model(prior)
    vocabulary = vocabulary_of(examples)
    if not vocabulary.size:
        return Model(prior)
    spread = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, df = frequencies(texts, spread, vocabulary.size)
    idf = np.log((1 + n) / (1 + df)) + 0.05

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [spread.value.numbers(t.as_py()) for t in batch.column(1)]
            packed = [pa.array([x[i].astype("<i4").tobytes() for x in own], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], names=["id", "y", "terms", "counts"])

    # max_examples rows of term counts
    rows = examples.select("id", "text", "y").mapInArrow(count, "id bigint, y int, terms binary, counts binary").collect()
    counts = [(np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in rows]
    index = BlockMaxIndex(vocabulary, idf, np.array([r["id"] for r in rows]), np.array([r["y"] for r in rows]), counts, prior, k)
    spread = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        place = {name: i for i, name in enumerate(own.names.tolist())}
        for batch in batches:
            at = [place[x] for x in batch.column(0).to_pylist()]
            votes = []
            for i in range(0, len(at), TOGETHER):
                queries = [own.vocabulary.numbers(t.as_py()) for t in batch.column(1)[i : i + TOGETHER]]
                votes += map(own.vote, own.nearest(queries, at[i : i + TOGETHER]))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(2)], names=["vote", "y"])

    # max_examples votes; a few examples a task, as each costs a search
    dealt = examples.select("id", "text", "y").repartition(partitions(spark), "id")
    votes = dealt.mapInArrow(left_out, "vote double, y int").toArrow()
    return Model(prior, spread, Calibration(votes["vote"].to_numpy(), votes["y"].to_numpy(), prior))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``toxicity``: ``score`` and, as ``evidence``, the nearest examples' ids with their cosines."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} is already there")
    ddl = "struct<score:double,evidence:array<struct<id:bigint,cosine:double,label:int>>>"
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])
    if model.index is None:
        return docs.withColumn(out_col, F.struct(F.lit(float(model.prior)).alias("score"), F.from_json(F.lit("[]"), "array<struct<id:bigint,cosine:double,label:int>>").alias("evidence")))
    spread, calibration = model.index, model.calibration

    @F.arrow_udf(ddl)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        own = spread.value
        for texts in batches:
            out = []
            for i in range(0, len(texts), TOGETHER):
                for near in own.nearest([own.vocabulary.numbers(t.as_py()) for t in texts[i : i + TOGETHER]]):
                    evidence = [{"id": int(own.names[i]), "cosine": float(c), "label": int(own.labels[i])} for c, i in zip(near[0][:3], near[1][:3], strict=True)]
                    out.append({"score": calibration.score(own.vote(near)), "evidence": evidence})
            yield pa.array(out, kind)

    return docs.withColumn(out_col, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
