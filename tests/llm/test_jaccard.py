"""Near-duplicate classes against brute force over all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from promptmill.llm import jaccard
from promptmill.llm.graphs import components
from promptmill.llm.jaccard import STEP, VALUES, required, similar

SCHEMA = "doc_id long, text string, node string, m int"


def grams(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(least.get(label[i], d), d)
    return sorted((-1 if d is None else d, least.get(label[i]), len(near[i]), len(sets[i])) for i, (d, _) in enumerate(rows))


def documents(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        for copy in range(rng.randrange(1, 12)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((10 * len(rows), " ".join(text), None, family))
    rows += [(rows[0][0] + 1, rows[0][1].replace(" ", "\n"), "x", 1), (None, rows[0][1], None, None), (5000, None, None, None),
             (5001, "", None, None), (5002, "two words", None, None), (5003, "two  words", None, None), (5004, "words two", None, None),
             (rows[3][0], rows[3][1], None, 1), (rows[3][0], "another text under an id that is there already", None, 1)]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    rows = documents()
    got = similar(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute([r[:2] for r in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.n_links, r.n_grams) for r in got) == want


def test_empty_table(spark):
    assert similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(200):
        text = list(base)
        text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text), None, None))
    got = similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in got} == {0}
    assert sorted((r.doc_id, 0, r.n_links, r.n_grams) for r in got) == brute([r[:2] for r in rows])


def test_required_matches_bound_the_posterior():
    need = required(Fraction(4, 5), 1e-6)
    rng = np.random.default_rng(0)
    assert list(need) == list(range(STEP, VALUES + 1, STEP)) and all(0 <= m <= n for n, m in need.items())
    # At the threshold itself hardly any pair is dropped.
    matches = (rng.random((20000, VALUES)) < 0.8).cumsum(1)
    assert np.mean([(matches[:, n - 1] < m) for n, m in need.items()]) < 1e-3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_rows_of_one_id_and_of_none(spark):
    """A third of ids null and a third equal, each on texts of their own; rows in a thousand copies."""
    def text(i):
        return " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i) + tail) for i in range(300) for tail in ("", " end")]
    rows += [(None, text(5000))] * 1000 + [(9000, text(5000) + " end")]
    got = similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_links for r in got) == sorted([1] * 600 + [1000] * 1001)
    assert {r.class_id for r in got if r.n_links == 1000} == {9000}
