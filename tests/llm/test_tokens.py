import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, corpus, table
from tokenizers import Tokenizer

from folioworks.llm import packing, sharding, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab Z'\n\t s.é,!́ 1Σİ 　<|>中\x1c²"
    return corpus() + ["x <|ENDOFTEXT|> y", "x <|endoftext|>Y Z"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(800)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("lengths", [True, False])
def test_pieces_give_what_whole_texts_give(path, lengths):
    model, texts = Tokenizer.from_file(path), [t or "" for t in odd_texts()]
    expected = [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    got = tokens.PieceEncoder(path, tokens.tokenizer_kind(path), lengths).encode_many(texts)
    assert got == [len(x) for x in expected] if lengths else [np.frombuffer(x, "<u4").tolist() for x in got] == expected


def test_counts(spark):
    texts = odd_texts()[:80]
    expected = [len(x.ids) for x in Tokenizer.from_file(BYTE).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    rows = tokens.count_tokens(table(spark, texts), BYTE, batch_bytes=500).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == expected
    assert tokens.count_tokens(table(spark, texts).limit(0), BYTE).count() == 0
    with pytest.raises(ValueError, match="already"):
        tokens.count_tokens(table(spark, texts), BYTE, out_col="n_chars")


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["hello world", "", None, "  two  spaces "]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = tokens.count_tokens(table(spark, texts), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len(model.encode(t or "")) for t in texts]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        codes = token_files.Codes(token_files.encode_levels(ids))
        assert codes.span(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, max(n, 1), 30).tolist() if n else []:
            assert codes[i] == ids[i]
            j = min(n, i + 17)
            assert codes.span(i, j).tolist() == ids[i:j].tolist()


def test_files_give_back_the_ids(spark):
    texts = corpus()
    expected = [x.ids + [0] for x in Tokenizer.from_file(BYTE).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    path = token_files.write_token_files(table(spark, texts).repartition(5), BYTE, 0)
    start = 0
    for row, ids in zip(token_files.read_token_files(spark, path, with_ids=True).orderBy("doc_id").collect(), expected, strict=True):
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_files.write_token_files(spark.createDataFrame([], DOCS), BYTE, 0)
    assert token_files.read_token_files(spark, empty).count() == 0


def checked_pieces(rows, texts, end):
    expected = {i: x.ids + [end] for i, x in enumerate(Tokenizer.from_file(WORD).encode_batch_fast([t or "" for t in texts], add_special_tokens=False))}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or seq == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("max_queues", [4096, 3])
def test_packing(spark, max_queues):
    texts = corpus()
    checked_pieces(packing.pack(table(spark, texts).repartition(4), WORD, 1, max_queues=max_queues).collect(), texts, 1)


def test_packing_null_sources_and_empty_tables(spark):
    docs = spark.createDataFrame([(0, "a b", None), (1, None, "s")], "doc_id long, text string, source string")
    checked_pieces(packing.pack(docs, WORD, 1).collect(), ["a b", None], 1)
    assert packing.pack(docs.limit(0), WORD, 1).count() == 0


def test_queues_stay_near_their_share():
    rng = random.Random(5)
    sizes = {f"q{i:02}": rng.randint(1, 60000) for i in range(20)}
    queues = packing.Queues(sizes, 128, 2048)
    for q in sizes:
        for w in range(0, queues.total // queues.slots, 7):
            before, after, _ = queues.served(q, w)
            assert 0 <= after - before <= queues.slots
            assert abs(before - min(queues.slots * w, queues.total) * queues.granules[q] / queues.total) < len(queues.path[q])


def test_sharding(spark):
    texts = corpus() + ["copy of one text"] * 300
    rows = sharding.shard_documents(table(spark, texts), 8).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    sizes = [0] * 8
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes[r["shard"]] += r["size"]
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    # one text alone is larger than a shard's share; the others differ by less than the next largest text
    others = sorted(sizes)[:-1]
    assert max(sizes) > sum(sizes) / 8 and others[-1] - others[0] <= 4001


def test_shards_of_many_records_are_level(spark):
    texts = ["copy of one text"] * 1500 + [f"text {i} " + "x" * (i % 90) for i in range(3000)]
    sizes = [r["s"] for r in sharding.shard_documents(table(spark, texts), 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * max(sizes)


def test_sharding_edge_cases(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) in ([(0, 0), (0, 1), (1, 0), (1, 1)], [(0, 0), (1, 0), (1, 1), (1, 2)], [(0, 0), (0, 1), (0, 2), (1, 0)])
    assert sharding.levels([10, 0, 100], 50) == [20.0, 30.0, 0]


def test_tokens_are_looked_up_in_the_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 300)
    texts = corpus()
    ids = [x.ids + [0] for x in Tokenizer.from_file(BYTE).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    path = token_files.write_token_files(table(spark, texts), BYTE, 0)
    wanted = [(d, i) for d in (0, 7, 21, len(texts) - 1) for i in (0, 5, len(ids[d]) - 1, len(ids[d]))] + [(-1, 0), (10**6, 0)]
    found = token_files.tokens_at(spark, path, wanted)
    assert sorted(tuple(r) for r in found.collect()) == sorted({(d, i, ids[d][i]) for d, i in wanted if 0 <= d < len(ids) and i < len(ids[d])})
    assert token_files.tokens_at(spark, path, []).count() == 0
