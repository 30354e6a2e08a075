import re

import corpus_pipeline
from helpers import brute_components, words
from test_pages import brute_hits, marked_corpus
from test_tokens import checked_pieces


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = marked_corpus(spark)
    item = words(24, 77)
    extra = [("Abc " + words(50, 1),) for _ in range(3)] + [(words(50, 1) + " tail",), (f"{words(80, 8)} {item} {words(80, 9)}",), (item,)]
    extra = [(1000 + i, t, "en", "src0", len(t)) for i, (t,) in enumerate(extra)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", labels["toxic"]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    steps, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        steps[name] = (before, {r["doc_id"]: r["text"] for r in now.collect()})

    before, after = steps["toxicity"]
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    gone = set(before) - set(after)
    assert gone <= toxic and len(gone) > 0.9 * len(toxic - {None})

    before, after = steps["exact_dedup"]
    last = {}
    for i, t in sorted(before.items()):
        last[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")] = i
    assert set(after) == set(last.values())

    before, after = steps["near_dedup"]
    assert set(after) == {i for i, c in brute_components(before.items(), 5, 80).items() if i == c}

    before, after = steps["decontamination"]
    hits = {i: brute_hits(t, [(1, item)]) for i, t in before.items()}
    assert set(after) == {i for i, (n, hit, _) in hits.items() if hit <= 0.5 * n}
    assert all(brute_hits(t, [(1, item)])[1] == 0 for t in after.values())
    assert all(after[i] == before[i] for i in after if not hits[i][1])

    texts = [after[i] for i in sorted(after)]
    number = {d: i for i, d in enumerate(sorted(after))}
    pieces = [{**r.asDict(), "doc_id": number[r["doc_id"]]} for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()]
    checked_pieces(pieces, texts, 1)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
