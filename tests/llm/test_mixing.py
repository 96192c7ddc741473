"""Raking: marginals meet their targets, weights keep their bounds, draws repeat."""

import pytest
from pyspark.sql import functions as F

from promptmill.llm.mixing import described, raked, sampled

SCHEMA = "doc_id long, text string, source string, lang string, topic string, tokens string"


def test_marginals_meet_their_targets(spark):
    cells = [(f"s{s}", f"l{g}", t, 1000 * (s + 1) * (g + 2) * (t + 1) + 37 * ((s * g + t) % 5)) for s in range(4) for g in range(3) for t in range(3)]
    made = raked(spark.createDataFrame(cells, "source string, lang string, topic int, tokens long"), fraction=0.2, sweeps=16)
    total = sum(c[3] for c in cells)
    for m, at in (("source", 0), ("lang", 1), ("topic", 2)):
        got = {r[0]: r[1] for r in made.groupBy(m).agg(F.sum("weight")).collect()}
        natural = {}
        for c in cells:
            natural[c[at]] = natural.get(c[at], 0) + c[3]
        parts = sum(n ** 0.5 for n in natural.values())
        for value, n in natural.items():
            assert got[value] == pytest.approx(0.2 * total * n ** 0.5 / parts, rel=1e-4)
    assert all(0 <= r.weight <= r.tokens for r in made.collect())


def rows():
    out = [(i, f"word{i % 7} word{i % 7} and more " * (i % 9), f"s{i % 3}", "en" if i % 2 else None, None, None) for i in range(400)]
    return out + [(None, "null id text", None, None, "x", "1"), (5, "same id", "s1", "en", None, None), (5, "same id", "s1", "en", None, None),
                  (900, None, "s1", "de", None, None), (901, "", "s1", "de", None, None)]


def test_draws(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = sorted(map(str, sampled(docs, keep=("text",)).collect()))
    again = sorted(map(str, sampled(docs.repartition(5), keep=("text",)).collect()))
    assert first == again and len(first) == len(rows())
    got = sampled(docs).collect()
    assert all(0 <= r.probability <= 1 for r in got) and all(not r.taken for r in got if r.tokens == 0)
    drawn, held = sum(r.probability * r.tokens for r in got), sum(r.tokens for r in got)
    assert drawn == pytest.approx(0.5 * held, rel=0.05)
    assert 0.3 < sum(r.taken for r in got) / len(got) < 0.7
    assert sampled(docs.limit(0)).count() == 0


def test_topics_follow_the_most_frequent_word(spark):
    docs = spark.createDataFrame([(1, "Tree tree house", "s", "l", None, None), (2, "TREE a b c", "s", "l", None, None), (3, "a b c", "s", "l", None, None)], SCHEMA)
    topic = {r.doc_id: r.topic for r in described(docs).collect()}
    assert topic[1] == topic[2] >= 0 and topic[3] == -1


def test_rows_without_id_draw_by_their_texts(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"word{i} and more of it", f"s{i % 2}", "en", None, None) for i in range(1500)], SCHEMA)
    got = sampled(docs).collect()
    for none in (True, False):
        some = [r for r in got if (r.doc_id is None) == none]
        assert sum(r.taken * r.tokens for r in some) == pytest.approx(sum(r.probability * r.tokens for r in some), rel=0.12)
