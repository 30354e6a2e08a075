"""Public tokenizers inside Arrow functions.

``PieceEncoder`` cuts texts where a tokenizer cannot see across and remembers
the ids of common pieces and words, so that each worker seldom encodes one
twice.  A text without double spaces is cut before every space: byte-level BPE
splits words there before merging (white space before the space stays with the
left piece either way), and word-end BPE drops the white space.  Texts with
double spaces are cut before white space that follows something else.
Tokenizers of other kinds get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import Remembered, held

#: Unicode white space and separators other than space, tab and line ends.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
SPACED = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
CAREFUL = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")
#: Half of the pieces that a worker remembers at most (about 200 bytes each), and the longest it remembers.
REMEMBERED, LONGEST = 200_000, 48
# The words that the two kinds of tokenizers split texts into, and the characters that stand for bytes.
SPACED_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BARE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same for pieces that hold nothing but visible characters below U+0250, which are in composed form already.
VISIBLE = re.compile("[!-~\xa1-\xac\xae-\u024f]+")
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACED_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^ {LETTERS}{DIGITS}]+")
BARE_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


def tokenizer_kind(path: str) -> str:
    """``spaced`` (byte-level BPE), ``bare`` (white space is dropped), ``whole`` or ``sentencepiece``."""
    if path.endswith(".model"):
        return "sentencepiece"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", [])):
        return "whole"
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "spaced"
    steps = before.get("pretokenizers", [])
    if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in str(steps[0]):
        return "bare"
    return "whole"


class PieceEncoder:
    """Whole texts to their ids as little-endian unsigned 32-bit bytes, or to their number."""

    def __init__(self, path: str, kind: str, lengths: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.kind, self.lengths, self.join = kind, lengths, sum if lengths else b"".join
        self.before = " " if kind == "spaced" else ""
        self.words, self.latin = {"spaced": (SPACED_WORDS, SPACED_LATIN), "bare": (BARE_WORDS, BARE_LATIN)}.get(kind, (None, None))
        self.pieces = Remembered(lambda p: self.of_part(p, self.before), REMEMBERED, LONGEST)
        self.marks = Remembered(self.of_word, REMEMBERED // 8, LONGEST)
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_padding()
        model.no_truncation()
        self.batch = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.model, self.normal = model.model, model.normalizer
        self.added = [t.content for t in model.get_added_tokens_decoder().values()]
        self.lower = model.normalizer is not None and model.normalizer.normalize_str("aZ~\xc0\u0178") == "az~\xe0\xff"

    def value(self, ids: list[int]):
        return len(ids) if self.lengths else array("I", ids).tobytes()

    def of_word(self, word: str):
        """A word as the tokenizer splits it off, by the merges of its model."""
        coded = word.replace(" ", BYTE_CHARS[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_CHARS)
        return self.value([t.id for t in self.model.tokenize(coded)])

    def of_part(self, part: str, before: str = ""):
        if self.words is None:
            return self.value(self.batch([before + part])[0])
        for content in self.added:
            if content in part:
                return self.value(self.batch([before + part])[0])
        if VISIBLE.fullmatch(part) and (self.normal is None or self.lower):
            if self.normal is not None:
                part = part.lower()
            words = self.latin.findall(before + part)
        else:
            part = before + part
            if self.normal is not None:
                part = self.normal.normalize_str(part)
            words = self.words.findall(part)
        if len(words) == 1:
            return self.of_word(words[0])
        if not self.before:
            return self.join(map(self.pieces.__getitem__, words))
        # a word behind a space is a piece, and remembered as such
        return self.join([self.pieces[w[1:]] if w[0] == " " and len(w) > 1 and w[1] != " " else self.marks[w] for w in words])

    def encode(self, text: str):
        if self.kind == "spaced" and "  " in text:
            if OTHER_SPACE.search(text):
                return self.join(map(self.of_part, CAREFUL.split(text)))
            # a space and a word is a piece like those below
            return self.join([self.pieces[c[1:]] if c[0] == " " else self.of_part(c) for c in SPACED.findall(text)])
        if self.kind == "bare":
            if self.lower and text.isascii():  # fewer pieces to remember
                lower = text.lower()
                text = text if any(content in lower for content in self.added) else lower
            return self.join(map(self.pieces.__getitem__, text.split(" ")))
        first, *rest = text.split(" ")
        return self.join([self.of_part(first), *map(self.pieces.__getitem__, rest)])

    def encode_many(self, texts: list[str]) -> list:
        if self.words is None:
            return [self.value(ids) for ids in self.batch(texts)]
        return [self.encode(t) for t in texts]


def encoder(path: str, kind: str, lengths: bool = False) -> PieceEncoder:
    """The worker's encoder, kept between tasks that use the same one."""
    return held((path, kind, lengths), lambda: PieceEncoder(path, kind, lengths))


def batches_by_bytes(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """The texts in order, in runs of about ``most`` UTF-8 bytes; a longer text is a run of its own."""
    sizes, start, size = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield pc.fill_null(texts.slice(start, i - start), "").to_pylist()
            start, size = i, 0
        size += n
    if len(sizes) > start:
        yield pc.fill_null(texts.slice(start), "").to_pylist()


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", batch_bytes: int = 1 << 20) -> DataFrame:
    """Adds the number of tokens of each whole text; no ids leave the Arrow function.

    Texts go to the library in runs of about ``batch_bytes``; long ones are cut
    at safe boundaries (see the module).  Begin, end and other special tokens
    are not added; their strings inside texts are handled as the library does
    by default.  Null and empty texts have no tokens; repeated rows are counted
    alike; an empty table stays empty.  ``out_col`` must not be there yet.
    """
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} is already there")
    kind = tokenizer_kind(path)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, kind, lengths=True)
        for texts in batches:
            found: list[int] = []
            for run in batches_by_bytes(texts, batch_bytes):
                found.extend(own.encode_many(run))
            yield pa.array(found, pa.int64())

    return docs.withColumn(out_col, lengths(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
