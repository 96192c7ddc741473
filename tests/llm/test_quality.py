"""Factorisation machine: the linear-time score against all pairs, held-out accuracy, odd rows."""

import random

import numpy as np

from promptmill.llm.common import word_names
from promptmill.llm.quality import RANK, SLOTS, STATISTICS, Machine, features, predicted, raw_scores

SCHEMA = "doc_id long, text string, score double, quality int"


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, rng.normal(size=STATISTICS + SLOTS), rng.normal(size=(STATISTICS + SLOTS, RANK)))
    texts = [b"some words, and some more.", None, b"x|y *** ABC", b"a " * 50]
    slots, values, at = features(word_names(), texts)
    got, _ = raw_scores(machine, slots, values, at)
    for k in range(len(texts)):
        s, x = slots[at[k]:at[k + 1]], values[at[k]:at[k + 1]]
        want = 0.3 + sum(machine.linear[i] * v for i, v in zip(s, x))
        want += sum(float(machine.factors[s[i]] @ machine.factors[s[j]]) * x[i] * x[j] for i in range(len(s)) for j in range(i))
        assert abs(want - got[k]) < 1e-9


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = [rng.choice(words) + ("" if good else rng.choice(["***", "%%%", "|"])) for _ in range(rng.randrange(15, 80))]
        rows.append((i, " ".join(text) + ".", None, None))
        labels.append((i, int(good), 0))
    rows += [(9000, None, None, 1), (9001, "", None, None), (None, "x", None, None), (5, rows[5][1], None, None)]
    known = spark.createDataFrame(labels + [(None, 1, 1), (77777, None, None)], "doc_id long, quality int, toxic int")
    got = predicted(spark.createDataFrame(rows, SCHEMA), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert predicted(docs, none).count() == 1 and predicted(docs.limit(0), none).count() == 0
