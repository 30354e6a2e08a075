"""The registered queries over the smallest given tables, against the definitions of their columns."""

import zlib

import duckdb
import numpy as np
import pytest
from test_dedup import brute_substrings
from test_tokens import BYTE, WORD, checked_pieces
from tokenizers import Tokenizer

from folioworks.llm import html_text, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def encoded(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(spark, docs):
    got = rows_of(spark, "op2_token_counts")
    for (i, t), ids in zip(docs.items(), encoded(BYTE, docs.values()), strict=True):
        r = got.pop(i)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), len(ids), len(ids) > 1024)
    assert not got


def test_shards(spark, docs):
    got = rows_of(spark, "op3_sharding")
    assert set(got) == set(docs) and {r["law"] for r in got.values()} == {"bytes"}
    sums = [0] * 16
    for i, r in got.items():
        data = (docs[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
        sums[r["shard"]] += r["size"]
    for s in range(16):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert max(sums) - min(sums) <= max(r["size"] for r in got.values())


def test_page_texts(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in queries.QUERIES["op4_html_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page, url, html in pages:
        text = " ".join(html_text.content_blocks(html or ""))
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, text, len(text))


def test_substrings(spark, docs):
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows_of(spark, "op5_substring_dedup").items()}
    expected = brute_substrings(list(docs.values()))
    assert got == {i: expected[n] for n, i in enumerate(docs)}


def test_packed_pieces(spark, docs):
    number = {d: n for n, d in enumerate(docs)}
    pieces = [{**r.asDict(), "doc_id": number[r["doc_id"]]} for r in queries.QUERIES["op6_packing"](spark, SF).collect()]
    checked_pieces(pieces, list(docs.values()), 1)


def test_token_files(spark, docs):
    got, start = rows_of(spark, "op7_token_files"), 0
    for i, ids in zip(docs, encoded(BYTE, docs.values()), strict=True):
        r = got.pop(i)
        ids = [*ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_toxicity_columns(spark, docs):
    got = rows_of(spark, "op9_toxicity")
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_tokenizers_differ():
    assert encoded(BYTE, ["a b"]) != encoded(WORD, ["a b"])
