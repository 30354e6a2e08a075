"""Scores of texts by an n-gram model of the corpus, kept in Elias-Fano tries.

1. Texts become numbers of words in batches of about ``TOKENS`` tokens, each with
   its own dictionary of 64-bit word hashes; the batches are written once.
2. Every batch asks for its distinct words and n-grams, with how often its own
   training texts have them: pre-aggregated, packed rows, dealt by a hash of the
   n-gram, so no frequent word or context gathers in one task.
3. A task adds up what the batches bring for its share and builds the share's
   levels: the words with their counts, and below them a trie of contexts and
   their successors.  Contexts, words, the pointers from contexts to their
   successors and the successors themselves are rising sequences in Elias-Fano
   form; a successor is numbered relative to its context, from where that context's
   share of the level starts.  Each successor has the quantised logarithm of its
   n-gram's probability.  The levels lie in a file that is mapped into memory.
4. The task answers its batches: a context is looked up, its pointers and first
   number read, and the word found by successor search inside that stretch.
5. Answers go back to their batch, which adds up the texts:
   ``p(w | h) = (c(h w) + prior * p(w | shorter h)) / (c(h) + prior)``, where
   ``p(w) = (c(w) + 1) / (N + V + 1)``; the probabilities of all known words and
   one unknown word add up to 1 in every context but for the quantisation.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and every text ends with one
end token; contexts at its start begin with a start token.  Null and empty texts
are an end alone.  Words are told apart by 64-bit hashes.  Null ids and repeated
rows are scored like others, each row for itself; a null in ``learns`` counts as
false.  An empty table gives no rows; without training texts every probability
is 1.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, mapped
from .near_dedup import LOWER, mixed
from .store import partitions, small_batches, written

#: Tokens of a batch, and of all batches for each share of the model.
TOKENS, SHARE = 2_000_000, 3_000_000
#: Bytes that are hashed together; longer words are hashed one by one.
SLICE, LONG = 1 << 19, 256
END, START = np.uint64(1), np.uint64(2)
#: Steps of the quantised logarithm in a power of ten, and the code of what was never seen.
STEPS, UNSEEN = 3000, 65535

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK = re.compile(rb"[\x20\x09-\x0D]")
FACTORS = mixed(np.arange(LONG, dtype=np.uint64) + np.uint64(0x1D2C3B4A5968)) | np.uint64(1)

BATCH = "batch bigint, ids array<bigint>, lengths binary, learns binary, words binary, tokens binary, n bigint, n_learned bigint, texts_learned bigint"
ASKED = "share int, role int, batch bigint, contexts binary, sizes binary, words binary, index binary, counts binary"
ANSWERS = "batch bigint, role int, share int, found binary, known bigint"


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def slice_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of some bytes, and where the words start."""
    own = np.frombuffer(data.translate(LOWER), np.uint8)
    edges = np.diff(np.concatenate([[False], ~SPACE[own], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    offset = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    at = np.repeat(starts, sizes) + offset
    terms = (own[at].astype(np.uint64) + np.uint64(1)) * FACTORS[np.minimum(offset, LONG - 1)]
    out = mixed(np.add.reduceat(terms, heads) + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(own[starts[i] : ends[i]].tobytes())
    return out, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and how many words each text has."""
    joined = b"\n".join([*texts, b""])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    parts, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(joined):
        cut = BLANK.search(joined, at + SLICE)
        end = cut.end() if cut else len(joined)
        own, starts = slice_hashes(joined[at:end])
        parts.append(own)
        if len(starts):
            first, last = np.searchsorted(bounds, [at + starts[0], at + starts[-1]], side="right") - 1
            places = np.searchsorted(starts + at, bounds[first : last + 2])
            counts[first : last + 1] += np.diff(places)
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *parts]), counts


def batches_of(docs: DataFrame, learns: Column, id_col: str, text_col: str) -> DataFrame:
    """Written rows ``BATCH`` of texts as numbers of words, frequent words first."""

    def batch_row(ids: list, learned: list[bool], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.concatenate(counts) + 1
        tokens = np.full(int(sizes.sum()), END, np.uint64)
        plain = np.ones(len(tokens), bool)
        plain[np.cumsum(sizes) - 1] = False
        tokens[plain] = np.concatenate(hashes)
        words, numbers, often = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        flags = np.array(learned, bool)
        n = [len(tokens), int(sizes[flags].sum()), int(flags.sum())]
        # a task that runs again writes other batches in the place of its first ones
        batch = uuid.uuid4().int >> 65
        columns = [squeezed(sizes.astype("<u4")), np.packbits(flags).tobytes(), words[order].astype("<u8").tobytes(), squeezed(rank[numbers].astype("<u4"))]
        arrays = [pa.array([batch], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in columns), *(pa.array([x], pa.int64()) for x in n)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BATCH.split(", ")])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, first, weight = [], 0, 0
            for i, text in enumerate(batch.column(2)):
                texts.append(text.as_py() or b"")
                weight += len(texts[-1])
                if weight < 4 * SLICE and i + 1 < len(ids):
                    continue
                hashes, counts = word_hashes(texts)
                for own, new in zip(held, (ids[first : i + 1], flags[first : i + 1], [hashes], [counts]), strict=True):
                    own.extend(new)
                size += len(hashes) + len(counts)
                texts, first, weight = [], i + 1, 0
                if size >= TOKENS:
                    yield batch_row(*held)
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield batch_row(*held)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text_col).cast("binary").alias("text"))
    return written(own.mapInArrow(tokenize, BATCH), "lm-batches", "none")


class Texts:
    """One batch: its tokens, and the distinct n-grams of two words and more, level by level."""

    def __init__(self, lengths: bytes, learns: bytes, words: bytes, tokens: bytes, order: int) -> None:
        self.sizes = opened(lengths, "<u4").astype(np.int64)
        self.words = np.frombuffer(words, "<u8")
        self.tokens = opened(tokens, "<u4").astype(np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        flags = np.unpackbits(np.frombuffer(learns, np.uint8))[: len(self.sizes)].astype(bool)
        self.learned = np.repeat(flags, self.sizes)
        width = len(self.words) + 1
        self.before = np.concatenate([[0], self.tokens[:-1]])
        self.before[self.heads] = width - 1  # the start token
        hashes = np.append(self.words, START)
        history, shorter = hashes[self.before], self.before
        valid = np.ones(len(self.tokens), bool)
        #: Of each level: hash of the context, number of the last word, training count; and of each place its n-gram or -1.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(2, order + 1):
            at = np.flatnonzero(valid)
            keys, first, own = np.unique(shorter[at] * width + self.tokens[at], return_index=True, return_inverse=True)
            place = np.full(len(self.tokens), -1, np.int64)
            place[at] = own
            contexts, last = history[at[first]], self.tokens[at[first]]
            self.levels.append((contexts, last, np.bincount(own[self.learned[at]], minlength=len(keys)), place))
            # the next level's context is this level's n-gram at the place before
            whole = mixed(contexts * np.uint64(0x9FB21C651E98DF25) + self.words[last] + np.uint64(level))
            valid = np.concatenate([[False], valid[:-1]])
            valid[self.heads] = False
            shorter = np.concatenate([[0], place[:-1]])
            history = whole[np.maximum(shorter, 0)]

    def word_shares(self, shares: int) -> list[np.ndarray]:
        return split(mixed(self.words + np.uint64(11)), shares)

    def gram_shares(self, shares: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """By share the n-grams of all levels, and their contexts, last words and counts."""
        contexts, last, counts = (np.concatenate([x[i] for x in self.levels]) for i in range(3))
        return split(mixed(contexts ^ mixed(self.words[last] + np.uint64(7))), shares), contexts, last, counts


def split(hashes: np.ndarray, shares: int) -> list[np.ndarray]:
    """Positions by share, in order."""
    owner = (hashes % np.uint64(shares)).astype(np.int64)
    by = np.argsort(owner, kind="stable")
    return np.split(by, np.searchsorted(owner[by], np.arange(1, shares)))


class Levels:
    """The trie of a share: contexts, their successors, and the quantised probabilities of their n-grams."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, total: int) -> None:
        """From distinct ``(context, word)`` with counts, by context, then word (hashes)."""
        heads = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
        vocabulary, number = np.unique(words, return_inverse=True)
        # numbers start anew with each context, behind the last one of the context before
        lasts = number[np.append(heads[1:], len(number)) - 1] if len(heads) else number
        starts = np.concatenate([[0], np.cumsum(lasts + 1)])
        follow = number + np.repeat(starts[:-1], np.diff(np.append(heads, len(number)))) if len(heads) else number
        codes = np.minimum(np.rint(STEPS * (np.log10(max(1, total)) - np.log10(np.maximum(counts, 1)))), UNSEEN - 1).astype(np.uint16)
        sequences = {"contexts": contexts[heads], "words": vocabulary, "pointers": np.append(heads, len(number)), "successors": follow}
        arrays = {"codes": codes}
        for name, values in sequences.items():
            arrays |= EliasFano.arrays(values, name)
        arrays = mapped(arrays)
        self.codes = arrays["codes"]
        self.contexts, self.words, self.pointers, self.successors = (EliasFano(arrays, name) for name in sequences)

    def probabilities(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Codes of n-grams: ``sizes[i]`` of them have the context ``i``, ``index`` tells their words."""
        out = np.full(len(index), UNSEEN, np.uint16)
        node, word = self.contexts.find(contexts), self.words.find(words)
        known = np.flatnonzero(node >= 0)
        first = np.zeros((3, len(contexts)), np.int64)
        if len(known):
            own = node[known]
            first[0, known], first[1, known] = self.pointers[own], self.pointers[own + 1]
            later = known[own > 0]
            first[2, later] = self.successors[first[0, later] - 1].astype(np.int64) + 1
        owner = np.repeat(np.arange(len(contexts)), sizes)
        asked = np.flatnonzero((node[owner] >= 0) & (word[index] >= 0))
        if len(asked):
            low, high, base = first[:, owner[asked]]
            number = (base + word[index[asked]]).astype(np.uint64)
            at = self.successors.successor(number)
            inside = np.flatnonzero((at >= low) & (at < high))
            inside = inside[self.successors[at[inside]] == number[inside]]
            out[asked[inside]] = self.codes[at[inside]]
        return out


def asked_rows(rows: DataFrame, shares: int, order: int) -> DataFrame:
    """Rows ``ASKED``: what each batch asks of each share, with its training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, *parts = (batch.column(c)[r].as_py() for c in range(5))
                yield from one(number, Texts(*parts, order))

    def one(number: int, texts: Texts) -> Iterator[pa.RecordBatch]:
        often = np.bincount(texts.tokens[texts.learned], minlength=len(texts.words))
        for share, own in enumerate(texts.word_shares(shares)):
            if len(own):
                yield row(share, 0, number, b"", b"", texts.words[own].tobytes(), b"", squeezed(often[own].astype("<u8")))
        shared, contexts, last, counts = texts.gram_shares(shares)
        for share, own in enumerate(shared):
            if len(own):
                context = contexts[own]
                heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                words, index = np.unique(last[own], return_inverse=True)
                sizes = np.diff(np.append(heads, len(own)))
                yield row(share, 1, number, context[heads].tobytes(), squeezed(sizes.astype("<u4")), texts.words[words].tobytes(), squeezed(index.astype("<u4")), squeezed(counts[own].astype("<u4")))

    def row(share: int, role: int, number: int, *parts: bytes) -> pa.RecordBatch:
        arrays = [pa.array([share], pa.int32()), pa.array([role], pa.int32()), pa.array([number], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ASKED.split(", ")])

    return rows.select("batch", "lengths", "learns", "words", "tokens").mapInArrow(ask, ASKED)


def answered(asked: DataFrame, total: int) -> DataFrame:
    """Written rows ``ANSWERS``: to each batch the counts of its words (role 1) and the codes of its n-grams (role 2); and each share's known words (role 0)."""
    names = [c.split()[0] for c in ANSWERS.split(", ")]

    def answer(share: int, number: int | None, role: int, found: bytes | None, known: int | None = None) -> pa.RecordBatch:
        arrays = [pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.array([share], pa.int32()), pa.array([found], pa.binary()), pa.array([known], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def word_answers(share: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(h[3], "<u8") for h in held]
        words, line = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, line, np.concatenate([opened(h[5], "<u8") for h in held]).astype(np.int64))
        words, counts = words[counts > 0], counts[counts > 0]
        arrays = mapped({"counts": counts, **EliasFano.arrays(words, "words")})
        level = EliasFano(arrays, "words")
        yield answer(share, None, 0, None, len(words))
        for h, own in zip(held, hashes, strict=True):
            at = level.find(own)
            found = np.zeros(len(own), np.int64)
            found[at >= 0] = arrays["counts"][at[at >= 0]]
            yield answer(share, h[0], 1, squeezed(found.astype("<u8")))

    def gram_answers(share: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        contexts = np.unique(np.concatenate([np.frombuffer(h[1], "<u8") for h in held]))
        words = np.unique(np.concatenate([np.frombuffer(h[3], "<u8") for h in held]))
        keys, counts = [], []
        for _, context, sizes, own, index, often in held:
            often = opened(often, "<u4").astype(np.int64)
            node = np.repeat(np.searchsorted(contexts, np.frombuffer(context, "<u8")), opened(sizes, "<u4"))
            key = node * len(words) + np.searchsorted(words, np.frombuffer(own, "<u8"))[opened(index, "<u4")]
            keys.append(key[often > 0])
            counts.append(often[often > 0])
        key, line = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.zeros(len(key), np.int64)
        np.add.at(often, line, np.concatenate(counts))
        levels = Levels(contexts[key // len(words)], words[key % len(words)], often, total)
        del keys, counts, key, line, often, contexts, words
        for number, context, sizes, own, index, _ in held:
            codes = levels.probabilities(np.frombuffer(context, "<u8"), opened(sizes, "<u4").astype(np.int64), np.frombuffer(own, "<u8"), opened(index, "<u4").astype(np.int64))
            yield answer(share, number, 2, squeezed(codes.astype("<u2")))

    def share_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                share, role, *row = (batch.column(c)[r].as_py() for c in range(8))
                if (share, role) != key:
                    if held:
                        yield from (gram_answers if key[1] else word_answers)(key[0], held)
                    key, held = (share, role), []
                held.append(tuple(row))
        if held:
            yield from (gram_answers if key[1] else word_answers)(key[0], held)

    dealt = asked.repartition(partitions(asked.sparkSession), "share").sortWithinPartitions("share", "role", "batch")
    return written(dealt.mapInArrow(share_answers, ANSWERS), "lm-answers", "none")


def score_texts(docs: DataFrame, learns: Column, order: int = 2, prior: float = 500.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` of every row; the rows where ``learns`` holds train the model.

    ``base_score`` adds up ``log10((c + 1) / (N + V + 1))``, ``score`` the logarithms of
    the model of n-grams of up to ``order`` words.
    """
    if order < 2:
        raise ValueError("the model needs n-grams of two words at least")
    spark = docs.sparkSession
    small_batches(spark)
    rows = batches_of(docs, learns, id_col, text_col)
    total, learned, texts_learned = (x or 0 for x in rows.agg(F.sum("n"), F.sum("n_learned"), F.sum("texts_learned")).first())
    shares = max(1, -(-total * (order - 1) // SHARE))
    found = answered(asked_rows(rows, shares, order), learned)
    known = found.filter("role = 0").agg(F.sum("known")).first()[0] or 0
    base = np.log10(learned + known + 1)

    def add_up(parts: list[tuple]) -> pa.RecordBatch:
        _, _, _, _, ids, *texts = parts[0]
        own = Texts(*texts, order)
        counts, codes = np.zeros(len(own.words), np.int64), np.full(sum(len(x[0]) for x in own.levels), UNSEEN, np.uint16)
        words, (grams, *_) = own.word_shares(shares), own.gram_shares(shares)
        for _, role, share, data, *_ in parts[1:]:
            if role == 1:
                counts[words[share]] = opened(data, "<u8")
            else:
                codes[grams[share]] = opened(data, "<u2")
        often = np.where(codes == UNSEEN, 0.0, learned * 10.0 ** (-codes.astype(np.float64) / STEPS))
        single = np.log10(counts[own.tokens] + 1) - base
        p = 10.0**single
        history = np.append(counts, texts_learned)[own.before].astype(np.float64)
        first = 0
        for contexts, _, _, place in own.levels:
            at = np.flatnonzero(place >= 0)
            count = np.zeros(len(p))
            count[at] = often[first + place[at]]
            p[at] = np.minimum(1.0, (count[at] + prior * p[at]) / (np.maximum(history[at], count[at]) + prior))
            history = np.concatenate([[0.0], count[:-1]])
            first += len(contexts)
        n_known = np.add.reduceat((counts[own.tokens] > 0).astype(np.int64), own.heads)
        columns = [own.sizes, n_known, np.full(len(own.sizes), learned), np.add.reduceat(single, own.heads), np.add.reduceat(np.log10(p), own.heads)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in columns)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                row = tuple(batch.column(c)[r].as_py() for c in range(batch.num_columns))
                if parts and row[0] != parts[0][0]:
                    yield add_up(parts)
                    parts = []
                parts.append(row)
        if parts:
            yield add_up(parts)

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "array<bigint>"), ("lengths", "binary"), ("learns", "binary"), ("words", "binary"), ("tokens", "binary"))]
    texts = rows.select("batch", F.lit(0).alias("role"), F.lit(0).alias("share"), F.lit(None).cast("binary").alias("found"), "ids", "lengths", "learns", "words", "tokens")
    answers = found.filter("role > 0").select("batch", "role", "share", "found", *none)
    dealt = texts.unionByName(answers).repartition(partitions(spark), "batch").sortWithinPartitions("batch", "role", "share")
    return dealt.mapInArrow(scores, f"`{id_col}` bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
