import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioworks.operators.chunking import extraction_status
from folioworks.operators.indexing import index_documents
from folioworks.sources import charsets, files, listing, work
from folioworks.streaming.jobs import ingest


def corpus(path):
    for name, data in {"a.txt": b"one", "d/b.MD": b"two", "node_modules/x.txt": b"no", "d/skip.csv": b"c,d", "e.log": b"log", "u.txt": "é".encode("utf-16")}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(data)
    return f"file://{path}"


def test_listing_and_decoding(spark, tmp_path):
    root = corpus(tmp_path)
    listed = {r["relative_path"]: r["size"] for r in files.list_files(spark, root, excludes=["d/skip*"]).collect()}
    assert listed == {"a.txt": 3, "d/b.MD": 3, "u.txt": 4}
    text = spark.read.format("binaryFile").load(f"{root}/u.txt").select(files.decoded(F.col("content")).alias("t")).first()["t"]
    assert text == "é"


RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю. В чащах юга жил бы цитрус."
POLISH = "Zażółć gęślą jaźń. Pójdźże, kiń tę chmurność w głąb flaszy; mężny bądź, chroń pułk twój i sześć flag."
JAPANESE = "いろはにほへと ちりぬるを。日本語の文章はひらがなとカタカナと漢字で書かれています。"
GREEK = "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία, και το κείμενο αυτό είναι γραμμένο στα ελληνικά."
FRENCH = "Dès Noël, où un zéphyr haï me vêt de glaçons würmiens, je dîne d'exquis rôtis de bœuf au kir."
CHINESE = "中文的文章用汉字写成,他们在这里说的是我们的国家和人民的生活。"
KOREAN = "모든 국민은 법 앞에 평등하며 한국어 문장은 한글로 쓰여 있습니다."


@pytest.mark.parametrize(
    ("text", "charset"),
    [
        (RUSSIAN, "cp1251"), (RUSSIAN, "koi8_r"), (RUSSIAN, "iso8859_5"), (RUSSIAN, "cp866"), (RUSSIAN, "utf-16-le"), (RUSSIAN.upper(), "cp1251"), (RUSSIAN.upper(), "koi8_r"),
        (POLISH, "iso8859_2"), (POLISH, "cp1250"), (POLISH, "utf-16-be"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), (JAPANESE, "utf-16-le"), (GREEK, "iso8859_7"), (GREEK, "cp1253"),
        (FRENCH, "cp1252"), (FRENCH, "iso8859_15"), (FRENCH, "utf-32"), (CHINESE, "gb18030"), (KOREAN, "euc_kr"), ("plain text", "utf-16-le"), ("plain text", "ascii"), ("It’s “quoted” – so", "cp1252"), ("20 °C ± 1, £5", "cp1252"),
    ],
)
def test_charsets(text, charset):
    assert charsets.detect(text.encode(charset))[0] == text


def test_what_is_no_text(spark):
    rows = [("txt", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x01"), ("txt", bytes(range(256)) * 3), ("md", b""), ("csv", " \n ".encode("utf-16")), ("txt", RUSSIAN.encode("koi8_r")), ("exe", b"\xff"), ("txt", None)]
    df = spark.createDataFrame(rows, "ext string, content binary")
    assert [r[0] for r in df.select(extraction_status(F.col("ext"), F.col("content"))).collect()] == ["unsupported_encoding", "unsupported_encoding", "empty_file", "no_extractable_text", "ok", "unsupported_type", "empty_file"]


def test_walked_trees(spark, tmp_path, monkeypatch):
    names = ["_a.txt", ".b.md", "a.txt", "sub/.c/_d.TXT", "sub/e.txt", "x/NODE_modules/f.txt", "x/.git/g.txt", "drafts/deep/h.txt", "x/y/z/w/v/i.txt", "noext", "x/.hidden", "x/j.log"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    expected = {"_a.txt", ".b.md", "a.txt", "sub/.c/_d.TXT", "sub/e.txt", "x/y/z/w/v/i.txt"}
    for subtrees in (1, 4, 256):
        monkeypatch.setattr(listing, "SUBTREES", subtrees)
        rows = listing.list_tree(spark, f"file://{tmp_path}", ("txt", "md"), ["drafts"]).collect()
        assert sorted(r["relative_path"] for r in rows) == sorted(expected)
        assert all(r["size"] == len(r["relative_path"]) and r["mtime"].timestamp() == pytest.approx((tmp_path / r["relative_path"]).stat().st_mtime, abs=1e-5) for r in rows)
    assert {r["file_name"] for r in listing.list_tree(spark, str(tmp_path)).collect()} >= {"noext", ".hidden", "j.log", "h.txt"}
    parts = listing.TreeReader(listing.Walk(str(tmp_path), None)).partitions()
    assert len(parts) > 5 and not any("node_modules" in p.relative.lower() for p in parts)
    assert listing.list_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_large_files_are_hashed_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "READ", 1000)
    data = {"a.bin": bytes(range(256)) * 40, "b.bin": b"", "c.bin": b"x" * 1000}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    listed = listing.list_tree(spark, str(tmp_path)).select("path", "file_name")
    gone = listed.limit(1).select(F.lit(f"file:{tmp_path}/gone.bin").alias("path"), F.lit("gone.bin").alias("file_name"))
    got = {r["file_name"]: r["sha256"] for r in listing.hash_files(listed.unionByName(gone)).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in data.items()} | {"gone.bin": None}


def test_extract_isolates_failures(spark):
    df = spark.createDataFrame([("a", b"x\n\ny"), ("b", b"!")], "path string, content binary")

    def make():
        def run(path, content):
            if content == b"!":
                raise ValueError
            return [(i + 1, t) for i, t in enumerate(content.decode().split("\n\n"))]

        return run

    got = [tuple(r) for r in files.extract(df, make).orderBy("path", "index").collect()]
    assert got == [("a", 0, 1, "x", None), ("a", 1, 2, "y", None), ("b", None, None, None, "ValueError")]


def test_artifacts_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    page = "struct<page_number:int,text:string>"
    first = spark.createDataFrame([("v1/a", "v1", [(1, "x"), (None, "y")])], f"address string, version string, pages array<{page}>")
    files.store_artifacts(first, path)
    again = first.unionByName(spark.createDataFrame([("v1/b", "v1", [(1, "z")])], first.schema))
    files.store_artifacts(again, path, spark.read.parquet(path))
    assert sorted(r["text"] for r in files.load_pages(spark, path).collect()) == ["x", "y", "z"]


def test_incremental_ingest(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    rows((1, "alpha beta"), (2, None)).write.mode("append").parquet(source)
    for n in (1, 2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest(stream, index_documents, out, f"file://{tmp_path}/state")
        assert spark.read.parquet(out).select("text").distinct().count() == n
        rows((3, "gamma")).write.mode("append").parquet(source)


@pytest.mark.parametrize(
    ("text", "charset"),
    [
        ("вервер!! дер!! я!! дер!! еине!! гцр!! я!! дер!! де", "cp1251"), ("еинц чде дер еря.", "koi8_r"), ("Erälich zuüber für ß, señor, año, ó así ó aquí, café à la crème", "cp1252"),
        ("Èvi, le oué éan éque et éoimentè par êéaux, ciónrami mañana ñu ñ", "cp1252"), ("die diestćłź. diestćłź. diestćłź. die", "iso8859_2"), ("用Python写A股", "utf-8"), ("A股 x股 B股 x的 y的 z的 A股 x股 B股", "utf-8"),
    ],
)
def test_charsets_of_odd_texts(text, charset):
    assert charsets.detect(text.encode(charset))[0] == text


def test_a_folder_tells_what_bytes_leave_open(spark):
    known, unsure = [("g", GREEK)] * 3 + [("r", RUSSIAN)] * 3, "διε βεβε ερβερ φθρ ενενϋκειτ θειν. βεβεϋ δερ ".encode("iso8859_7") * 9
    rows = [(f, t.encode("iso8859_7" if f == "g" else "cp1251")) for f, t in known] + [(f, unsure) for f in "grx"] + [("g", None), ("g", b"plain"), ("r", b"\xe4\xe9")]
    out = charsets.decoded_in_folders(spark.createDataFrame(rows, "folder string, content binary"), "folder").collect()
    assert len(out) == len(rows)
    told = {r["folder"]: r["text"] for r in out if r["content"] == unsure}
    assert (told["g"], told["r"]) == (unsure.decode("iso8859_7"), unsure.decode("cp1251")) and told["x"] == charsets.detect(unsure)[0]
    assert {r["text"] for r in out if r["content"] is None} == {None} and "plain" in [r["text"] for r in out]


def test_contents_of_several_batches_are_indexed_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for own in ([(1, "alpha beta"), (2, "alpha  beta"), (7, "alpha\n\nbeta")], [(3, "alpha beta"), (4, "gamma")], [(5, "gamma"), (6, "alpha beta")]):
        spark.createDataFrame(own, "doc_id long, text string").write.mode("append").parquet(source)
        ingest(spark.readStream.schema("doc_id long, text string").parquet(source), index_documents, out, f"file://{tmp_path}/state")
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["alpha beta", "gamma"]


def test_a_charset_costs_little_more_than_counting_its_letters():
    def seconds(f):
        start = time.perf_counter()
        f()
        return time.perf_counter() - start

    text = RUSSIAN * 2000
    data = text.encode("koi8_r")
    assert charsets.detect(data)[0] == text
    assert min(seconds(lambda: charsets.detect(data)) for _ in range(3)) < 6 * min(seconds(lambda: Counter(text)) for _ in range(3))


def test_only_white_space_is_no_extractable_text(spark):
    texts = ["", " \n\t", "\x0b\x0c\r ", "\u00a0", " a ", "\n.\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(extraction_status(F.lit("txt"), F.lit("x").cast("binary"), F.col("text"))).collect()
    assert [r[0] for r in got] == ["no_extractable_text"] * 3 + ["ok"] * 3


WESTERN = "Ciónasasta ciónuellí íquega ciónqueue íll ciónosarco. Éoiai parétrementeau laaielleéeux éleaiê. Étretion éèonan ètretionle."


def test_many_files_of_a_folder_outweigh_little_evidence_only(spark):
    known = [("w", FRENCH + f" {i}", "cp1252") for i in range(30)] + [("p", POLISH + f" {i}", "iso8859_2") for i in range(30)]
    rows = [*known, ("w", WESTERN, "cp1252"), ("p", "ć " * 24 + "rę " * 6, "iso8859_2"), ("w", RUSSIAN, "cp1251"), ("p", GREEK, "iso8859_7"), ("p", FRENCH, "cp1252")]
    df = spark.createDataFrame([(f, t.encode(c), t) for f, t, c in rows], "folder string, content binary, own string")
    out = charsets.decoded_in_folders(df, "folder").collect()
    assert len(out) == len(rows) and [r["own"] for r in out if r["text"] != r["own"]] == []
    assert charsets.detect(WESTERN.encode("cp1252"))[0] != WESTERN


def test_small_batches_leave_the_session_as_it_was(spark):
    with work.small_batches(spark):
        assert spark.conf.get(work.BATCH_SETTING) == str(work.BATCH_ROWS)
    assert spark.conf.get(work.BATCH_SETTING) == "10000"
    spark.conf.set(work.BATCH_SETTING, "64")
    with work.small_batches(spark):
        assert spark.conf.get(work.BATCH_SETTING) == "64"
    assert spark.conf.get(work.BATCH_SETTING) == "64"
    spark.conf.unset(work.BATCH_SETTING)


def test_repeated_words_are_no_more_evidence():
    lags = [{c: lag for _, c, lag in charsets.ranked((WESTERN * n).encode("cp1252"))} for n in (1, 2, 50)]
    assert 0 < lags[0]["cp1252"] < 5 and lags[2]["cp1252"] == pytest.approx(lags[1]["cp1252"], rel=0.1)
