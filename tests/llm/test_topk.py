"""Top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.llm import topk
from promptmill.llm.topk import Lists, nearest

SCHEMA = "vec_id long, embedding array<float>, id string, v int"


def brute(rows, asks, k):
    def scaled(v):
        return [math.floor(1024 * float(np.float32(x))) for x in v]
    use = sorted({(i, tuple(scaled(v))) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in use:
        if asks(q):
            scores = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q and len(a) == len(b)})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], None, None) for i in range(150)]
    rows += [(200 + i, list(rows[3][1]), None, None) for i in range(15)] + [rows[3], (300, None, None, None), (301, [], None, None),
             (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None), (303, [float("nan")] * 6, None, None), (304, [float("inf")] * 6, None, None),
             (310, [0.0] * 6, None, None), (305, [0.5, 0.25], None, None), (None, [0.1] * 6, None, None)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda q: q % 5 == 0, 10)


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def best(lists, vectors, q, own, k=10):
    ids, scores = lists.best(q, own, k)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(v, q)), i) for i, v in enumerate(vectors) if i != own)[:k]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want


def test_exact_with_zero_and_negative_components():
    vectors = np.random.default_rng(1).integers(-1000, 1000, (500, 8))
    vectors[7] = 5000
    lists = Lists(np.arange(500), vectors)
    for q in (np.array([1, 0, 0, 0, 0, 0, 0, 0]), np.array([3, -2, 5, 0, 1, 1, -9, 4]), np.zeros(8, int)):
        best(lists, vectors, q, 3)


def test_reading_stops_early_where_the_data_allow():
    """A few vectors are large throughout: a small part of the lists settles them."""
    rng = np.random.default_rng(2)
    vectors = (rng.pareto(1.2, (4000, 1)) * rng.uniform(200, 260, (4000, 16))).astype(np.int64)
    lists = Lists(np.arange(4000), vectors)
    for own in range(10):
        best(lists, vectors, rng.integers(1, 50, 16), own)
    assert lists.entries_read < 0.05 * 10 * vectors.size


@pytest.mark.parametrize("size", [1000, 2**26])
def test_many_dimensions_large_values_and_near_ties(size):
    """1,024 dimensions, sums within and beyond what doubles hold, rows one apart in a single component."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-size, size, (120, 1024))
    vectors[60:] = vectors[5]
    vectors[60:90, 17] += np.arange(30) % 3 - 1
    lists = Lists(np.arange(120), vectors)
    for own in (0, 5, 70):
        best(lists, vectors, vectors[own], own)
