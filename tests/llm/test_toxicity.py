"""Compression distance: held-out accuracy on a small fixture, and texts without words."""

import random

import numpy as np
from pyspark.sql import functions as F

from promptmill.llm.toxicity import gains, predicted, train

SCHEMA = "doc_id long, text string, score double, toxic int"


def documents(n=500, seed=7):
    rng = random.Random(seed)
    parts = ["an", "ti", "the", "on", "er", "sho", "la", "mi", "que", "ver"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 150))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vexnog", "grumplod", "zukbur" + rng.choice(parts)])
        rows.append((i, " ".join(words), None, None))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = documents()
    rows += [(9000, None, 1.0, 1), (9001, "", None, 0), (9002, " \n", None, None), (None, "some text", None, None), (3, rows[3][1], None, None)]
    known = spark.createDataFrame(labels + [(9003, None, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = predicted(spark.createDataFrame(rows, SCHEMA), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    said = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500}
    right = [said[i].predicted == t for i, _, t in labels if i in said]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert {r.score for r in got if r.doc_id in (9000, 9001, 9002)} == {[r.score for r in got if r.doc_id == 9001][0]}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in predicted(docs, none).collect()] == [0]
    assert predicted(docs.limit(0), none).count() == 0
    one = none.union(spark.range(5).select("id", F.lit(1)))
    assert predicted(docs, one).count() == 1


def test_ordinary_text_saves_nothing():
    rows, labels = documents(200, 1)
    texts = [r[1].encode() for r in rows]
    model = train([t for t, (_, _, x) in zip(texts, labels) if x], [t for t, (_, _, x) in zip(texts, labels) if not x])
    gain = gains([b"the an on er la mi " * 40, b"the an vexnog on er la mi grumplod an", None], model)
    assert gain[0, 1] == 0 and gain[1, 0] > 3 and not gain[2].any()
