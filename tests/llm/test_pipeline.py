"""The pipeline's stages on a small corpus: what each must drop, cut or keep."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_toxicity import documents


def test_stages_take_effect(spark, tmp_path):
    rows, labels = documents(300, 11)
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, t + (f"\n{passage}" if i in (41, 42, 43) else ""), "en", f"s{i % 3}", len(t)) for i, t, *_ in rows]
    docs += [(1000, docs[5][1], "en", "s0", 1), (1001, docs[5][1] + " end", "de", "s1", 1), (None, "a text of its own with no id at all", None, None, None),
             (1002, None, "en", "s1", 0), (1003, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = held
        if k < 4:
            assert sorted(held.columns) == sorted(corpus_pipeline.COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = [{r.doc_id for r in kept[n].select("doc_id").collect()} for n in names]
    toxic = {i for i, _, t in labels if t}
    clean = {d[0] for d in docs} - toxic
    assert len(ids[0] & toxic) <= 0.1 * len(toxic) and len(ids[0] & clean) >= 0.97 * len(clean)
    assert ids[1] == ids[0] - {1000, 1001}
    assert ids[2] == ids[1]
    cut = {r.doc_id: r.text for r in kept[names[2]].collect()}
    assert passage in cut[41].replace("\n", " ") and "shared5" not in cut[42] + cut[43]
    before = {r.doc_id: r.text for r in kept[names[1]].collect()}
    assert all(cut[i] == t for i, t in before.items() if i not in (42, 43) and t)
    assert ids[3] < ids[2] and ids[4] == ids[3]
    assert all(r.n_tokens > 0 for r in kept[names[4]].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[names[4]].count()


def test_rows_of_equal_and_null_ids_are_decided_each_for_itself(spark, tmp_path, monkeypatch):
    def text(name):
        return " ".join(f"{name}{k}" for k in range(40))

    rows = [(None, text("bad"), "en", "s0", 1), (None, text("fine"), None, "s1", 2), (7, text("bad"), "en", None, None), (7, text("good"), "en", "s1", 3),
            (None, text("fine"), None, "s1", 2), (8, text("copy"), "en", "s0", 4), (8, text("copy"), "en", "s0", 4), (8, text("copy"), "de", "s0", 4),
            (None, text("copy") + " end", "en", "s0", 5), (8, text("other"), "en", "s0", 6), (None, None, "en", "s1", 0), (None, "", "en", "s1", 0), (None, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    real = corpus_pipeline.scored
    monkeypatch.setattr(corpus_pipeline, "scored", lambda docs, *a, **k: real(docs, *a, **k).drop("score").withColumn(
        "score", F.when(F.col("text").startswith("bad0"), 1.0).otherwise(0.0)))
    clean = corpus_pipeline.not_toxic(spark, docs, str(tmp_path))
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not (r[1] or "").startswith("bad"))

    one = corpus_pipeline.one_of_each_class(spark, clean, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in one) == Counter({
        (None, text("fine")): 1, (7, text("good")): 1, (8, text("copy")): 1, (8, text("other")): 1, (None, None): 2, (None, ""): 1})
    assert all(tuple(r) in rows for r in one)

    mixed = corpus_pipeline.sampled
    monkeypatch.setattr(corpus_pipeline, "sampled", lambda docs, **k: mixed(docs, **k).withColumn("taken", F.col("tokens") == 41))
    taken = corpus_pipeline.mixed_to_targets(spark, docs, str(tmp_path))
    assert list(map(tuple, taken.collect())) == [r for r in rows if r[1] == text("copy") + " end"]
