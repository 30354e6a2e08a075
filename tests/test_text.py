import uuid

import pytest
from pyspark.sql import functions as F

from folioworks.functions import ids, paths, text, times, vectors
from folioworks.operators import chunking

C = F.col


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def chunks_of(spark, pages, target, overlap):
    rows = [("d", i, number, " ".join(f"w{i}_{j}" for j in range(n))) for i, (number, n) in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc string, index int, page_number int, text string")
    return chunking.chunk_pages(df, "doc", target, overlap).orderBy("chunk_index").collect()


@pytest.mark.parametrize(
    ("pages", "target", "overlap", "expected"),
    [
        ([(i, 30) for i in range(1, 6)], 100, 10, [(90, 1, 3), (60, 4, 5)]),
        ([(i, 50) for i in range(1, 4)], 50, 10, [(50, 1, 1), (50, 2, 2), (50, 3, 3)]),
        ([(7, 250)], 100, 20, [(100, 7, 7), (100, 7, 7), (90, 7, 7)]),
        ([(1, 10), (2, 0), (3, 10)], 100, 10, [(20, 1, 3)]),
        ([(None, 10), (None, 10)], 100, 10, [(20, None, None)]),
        ([], 100, 10, []),
    ],
)
def test_chunks(spark, pages, target, overlap, expected):
    rows = chunks_of(spark, pages, target, overlap)
    assert [(r["token_count"], r["page_start"], r["page_end"]) for r in rows] == expected
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_windows_overlap(spark):
    a, b, _ = [r["text"].split() for r in chunks_of(spark, [(7, 250)], 100, 20)]
    assert a[-20:] == b[:20]


def test_csv_sections(spark):
    def sections(rows):
        df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "f string, i int, cells array<string>")
        return [r["section"] for r in chunking.csv_sections(df, "f", "i").orderBy("index").collect()]

    assert sections([["name", "role"], ["", " "], ["Ada", "engineer", "extra"]]) == ["name | role\nname: Ada | role: engineer"]
    assert [s.split("\n")[0] for s in sections([["a", "b"], *[[str(i), "x"] for i in range(250)]])] == ["a | b"] * 3
    assert sections([["only", "header"]]) == ["only | header"]


def test_sections_and_status(spark):
    df = spark.createDataFrame([("d", "one\n\n  two \n \t\n\nthree")], "d string, text string")
    assert [r["section"] for r in chunking.text_sections(df, "d").orderBy("index").collect()] == ["one", "two", "three"]
    rows = [("pdf", b"x"), ("txt", b""), ("md", b"\x89PNG\r\n\x1a\n\x00"), ("md", b"\xff\xfe"), ("csv", b" \n"), ("txt", b"ok"), ("txt", None)]
    got = spark.createDataFrame(rows, "e string, c binary").select(chunking.extraction_status(C("e"), C("c")).alias("s")).collect()
    assert [r["s"] for r in got] == ["unsupported_type", "empty_file", "unsupported_encoding", "no_extractable_text", "no_extractable_text", "ok", "empty_file"]


def test_normalize_and_hashes(spark):
    assert one(spark, text.normalize_text(C("t")), t="  cafe\u0301 \u00a0\t x\x1c\n") == "caf\u00e9 x"
    same = [one(spark, ids.text_hash(F.array(C("a"), C("b"))), a=a, b=b) for a, b in (("hello", "world"), ("hello  ", " world\n"))]
    assert same[0] == same[1]
    name = "c:abc:3"
    assert one(spark, ids.uuid5(ids.CHUNK_NAMESPACE, C("n")), n=name) == str(uuid.uuid5(uuid.UUID(ids.CHUNK_NAMESPACE), name))


def test_composition_leaves_python_out_and_takes_few_rows_at_once(spark):
    import re
    import unicodedata

    import pyarrow as pa

    own = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), text.COMPOSED) + "]")
    parts = [unicodedata.decomposition(chr(c)).split() for c in range(0x30000)]
    later = {int(x, 16) for p in parts if p and p[0][0] != "<" for x in p[1:]} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    safe = [c for c in range(0x30000) if own.match(chr(c))]
    assert len(safe) > 30_000 and all(unicodedata.is_normalized("NFC", chr(c)) and not unicodedata.combining(chr(c)) and c not in later for c in safe)
    texts = ["plain", "\u00e9\u4e00\uac00\U0001f600", "e\u0301", "\u1100\u1161\u11a8", "\uac00\u11a8", "\u212b", "\u037e", "q\u0323\u0307 q\u0307\u0323", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["c"] for r in rows.select("n", text.nfc(F.col("t")).alias("c")).collect()}
    assert got == {n: None if t is None else unicodedata.normalize("NFC", t) for n, t in enumerate(texts)}
    sizes = []
    assert text.by_parts(pa.array(range(1000)), lambda part: sizes.append(len(part)) or part, 300).to_pylist() == list(range(1000))
    assert sizes == [300, 300, 300, 100] and len(text.by_parts(pa.array([], pa.string()), lambda part: part)) == 0


def test_keyword_expansion(spark):
    assert one(spark, text.expand_terms(C("t")), t="Albert's job a") == ["albert", "job", "role", "position", "employment", "experience"]
    assert one(spark, text.keyword_terms(C("t")), t="a ? !") == []


def test_paths(spark):
    assert one(spark, paths.display_path(C("s"), C("r"), C("p")), s="windows", r="C:\\D\\", p="a/b.txt") == "C:\\D\\a\\b.txt"
    assert one(spark, paths.source_name(C("p")), p="Z:\\x\\f.md") == "f.md"
    assert one(spark, paths.extension(C("n")), n="A.B.TXT") == "txt"
    assert one(spark, paths.extension(C("n")), n=".hidden") == ""
    assert one(spark, paths.in_excluded_dir(C("p")), p="a/Node_Modules/x.txt") is True
    assert one(spark, paths.matches_glob(C("p"), ["drafts"]), p="drafts/deep/x.txt") is True
    assert one(spark, paths.matches_glob(C("p"), ["*.tm[pq]"]), p="a/b.tmp") is True
    assert one(spark, paths.root_problem(C("p"), F.lit("linux"), [("/data", "linux")]), p="/database") == "not_allowed"
    assert one(spark, paths.root_problem(C("p"), F.lit("linux"), [("/data", "linux")]), p="/data/../x") == "not_absolute"


def test_times(spark):
    at = F.to_timestamp(F.lit("2027-01-01 02:00:00.120000"))
    assert one(spark, times.iso_utc(at)) == "2027-01-01T02:00:00.12Z"
    assert one(spark, times.iso_utc(F.to_timestamp(F.lit("2027-01-10 02:00:00")))) == "2027-01-10T02:00:00Z"
    assert one(spark, times.week_bucket(at)) == "2026-53"
    assert one(spark, times.backup_time(C("n")), n="20260102T030405Z").isoformat() == "2026-01-02T03:04:05"
    assert one(spark, times.backup_time(C("n")), n="nope") is None


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, F.array(vectors.dot(a, b), vectors.cosine(a, b), vectors.euclid(a, b))) == pytest.approx([3.0, 0.6, 20**0.5])
    assert one(spark, vectors.percent(F.lit(1), F.lit(16))) == 6.2
    assert one(spark, vectors.percent(F.lit(0), F.lit(0))) == 0.0


def test_terms_and_lengths_are_computed_once(spark):
    from folioworks.operators.embedding import hashed

    # values that differ each time they are computed: one random term is in one slot, random vectors get unit length
    rows = spark.range(40)
    term = F.replace(F.expr("uuid()"), F.lit("-"))
    for r in rows.select(hashed(term, 8).alias("v")).collect():
        assert sorted(r["v"]) == [0.0] * 7 + [1.0]
    for r in rows.select(vectors.normalize(F.array(F.rand(), F.rand(), F.rand())).alias("v")).collect():
        assert sum(x * x for x in r["v"]) == pytest.approx(1.0)
    assert spark.range(1).select(vectors.normalize(F.expr("CAST(NULL AS array<double>)")).alias("v")).first()["v"] is None


def test_model_embedding_runs_in_batches_and_checks_sizes(spark):
    from folioworks.operators.embedding import embed, hashed, with_context

    class Doubling:  # pickled by value, as workers cannot import the tests
        def embed(self, texts):
            return [[float(len(t)), 2.0 * len(t)] for t in texts]

    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    assert [list(r["vector"]) for r in embed(df, "t", 2, Doubling, batch=1).collect()] == [[1.0, 2.0], [3.0, 6.0]]
    with pytest.raises(Exception, match="another number or size"):
        embed(df, "t", 3, Doubling).collect()
    assert one(spark, with_context(C("t"), C("n")), t="x", n="my_file-1.md") == "[File: my file 1 md]\nx"
    assert sum(x * x for x in one(spark, hashed(C("t"), 8), t="some words here")) == pytest.approx(1.0)


def test_vector_search_in_batches(spark, monkeypatch):
    from folioworks.operators import search, vector_index

    points = spark.createDataFrame([(f"p{i}", [float(i % 7 + 1), float(i % 5), float(i)]) for i in range(40)], "point_id string, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i % 9), float(i % 4)]) for i in range(25)], "query_id long, vector array<double>")
    whole = sorted(search.vector_leg(points, queries, 3).collect())
    monkeypatch.setattr(vector_index, "TOGETHER", 10)
    assert sorted(search.vector_leg(points, queries, 3).collect()) == whole and len(whole) == 75


def test_query_vectors_are_one_each(spark):
    from folioworks.operators.embedding import embed_queries

    class Model:
        def __init__(self, extra=0):
            self.extra = extra

        def embed_query(self, text):
            return [[float(len(text)), 0.0]] * (1 + self.extra)

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, t string")
    assert {r["id"]: r["vector"] for r in embed_queries(df, "t", 2, Model).collect()} == {1: [3.0, 0.0], 2: None, 3: [0.0, 0.0]}
    for size, extra in ((3, 0), (2, 1), (2, -1)):
        with pytest.raises(Exception, match="one vector"):
            embed_queries(df, "t", size, lambda extra=extra: Model(extra)).collect()
    assert embed_queries(df.limit(0), "t", 2, Model).count() == 0


def test_chunks_by_another_tokenizer(spark):
    from folioworks.operators.chunking import chunk_pages

    pages = spark.createDataFrame([(1, 0, None, "abcdefg")], "id long, index int, page_number int, text string")
    rows = chunk_pages(pages, "id", 4, 1, tokenize=lambda t: F.filter(F.split(t, ""), lambda c: c != "")).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["a b c d", "d e f g"] and [r["token_count"] for r in rows] == [4, 4]


def test_changed_and_stored_files_are_left_out(spark):
    from folioworks.functions.ids import chunking_profile
    from folioworks.operators.indexing import index_documents, index_files

    files = spark.createDataFrame([(1, "a.txt", b"one text", None), (2, "b.txt", b"one  text", None), (3, "c.txt", b"changed", "0"), (4, "d.txt", b"stored", None), (5, "e.txt", b" ", None), (6, "f.txt", None, None)], "file_id long, name string, content binary, sha256 string")
    files = files.withColumn("sha256", F.coalesce("sha256", F.sha2("content", 256)))
    content = index_documents(spark.createDataFrame([(1, "stored")], "doc_id long, text string")).first()["content_id"]
    stored = spark.createDataFrame([(content, chunking_profile(200, 20), "e")], "content_id string, chunking_profile string, embedding_profile string")
    rows = index_files(files, stored, "e").collect()
    assert [r["text"] for r in rows] == ["one text"] and len(rows[0]["vector"]) == 8
    assert {r["text"] for r in index_files(files, stored, "other").collect()} == {"one text", "stored"}
    assert {r["text"] for r in index_files(files, stored, "e", forced=True).collect()} == {"one text", "stored"}


def test_files_are_cut_once(spark):
    from folioworks.operators.indexing import index_files

    files = spark.createDataFrame([(n, "a.txt", f"some text {n}".encode()) for n in range(3)], "file_id long, name string, content binary").withColumn("sha256", F.sha2("content", 256))
    stored = spark.createDataFrame([], "content_id string, chunking_profile string, embedding_profile string")
    points = index_files(files, stored, "e1")
    # chunks are counted and embedded from one written table
    assert "cut(" not in points._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["text"] for r in points.collect()) == [f"some text {n}" for n in range(3)]


def test_white_space_is_that_of_python(spark):
    from folioworks.functions.text import collapse_space, tokens

    signs = [chr(i) for i in range(0x3100) if chr(i).isspace()] + ["\x00", "\x1b", "!", "~", "é", "᠎", "​", "﻿", "日", "😀"]
    rows = [(f"{a}{b}x{a}y {b}{a}{a}z{b}",) for a in signs for b in signs]
    out = spark.createDataFrame(rows, "text string").select("text", collapse_space(F.col("text")).alias("own"), tokens(F.col("text")).alias("toks")).collect()
    assert all(r["own"] == " ".join(r["text"].split()) and r["toks"] == r["text"].split() for r in out)


def test_texts_are_cut_where_they_stand(spark):
    from folioworks.operators.chunking import chunk_pages, chunk_texts, text_sections

    texts = [(1, "a b\n \t\n\nc d e\r\n\r\n f"), (2, " \n\n "), (3, None), (4, " ".join(map(str, range(25))) + "\n\n" + " ".join("xyz")), (5, "\n\n\x1fa\n\n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = chunk_texts(docs, "doc_id", 10, 2)
    pages = text_sections(docs, "doc_id").select("doc_id", "index", F.lit(None).cast("int").alias("page_number"), F.col("section").alias("text"))
    assert sorted(own.collect()) == sorted(chunk_pages(pages, "doc_id", 10, 2).collect()) and own.count() > 4
    # neither gathered nor sent anywhere
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_texts_travel_once(spark):
    from folioworks.operators.indexing import index_documents

    docs = spark.createDataFrame([(2, "one\n\ntwo"), (1, "one two"), (3, "one  two"), (4, "x")], "doc_id long, text string")
    out = index_documents(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_list" not in plan
    assert sorted(r["text"] for r in out.collect()) == ["one two", "x"]
