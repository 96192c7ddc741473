"""Centroids by subvector dictionaries against plain k-means in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from promptmill.llm import centroids
from promptmill.llm.centroids import chunks, clusters, distances, encoded_chunk, vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, e string"


def plain(rows, count, rounds=10):
    """(vec_id, cluster, distance, cluster inertia, inertia, sha256) of rows (vec_id, components)."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    named = sorted((i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, _, v in named[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        for k, vs in held.items():
            centres[k] = [sum(xs) // len(vs) for xs in zip(*vs, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in found]


def some(n, seed=5):
    rng = random.Random(seed)
    return [(i, [rng.choice((-0.5, 0.25, 0.1, 0.9, -0.003)) + (i % 5) * 0.3 for _ in range(64)]) for i in range(n)]


def told(spark, rows):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *(-1 if x is None else x for x in r)))


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_equals_plain_rounds(spark, monkeypatch, width):
    monkeypatch.setattr(centroids, "CHUNK", 37)
    rows = some(120)
    # A third of the rows are copies of one; ids repeat and are null; vectors that take no part.
    rows += [(7, rows[0][1])] * 60 + [(None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, [0.5] * 63), (902, [math.nan] * 64), (903, [math.inf] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [])]
    got = clusters(told(spark, rows).repartition(3), width=width).collect()
    assert ordered(got) == ordered(plain(rows, 8))


def test_few_rows_and_none(spark):
    rows = some(3)
    assert ordered(clusters(told(spark, rows)).collect()) == ordered(plain(rows, 8))
    empty = clusters(told(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_all_equal_and_far_vectors(spark):
    same = [(i, [1.5] * 64) for i in range(30)]
    assert ordered(clusters(told(spark, same)).collect()) == ordered(plain(same, 8))
    far = some(20) + [(50, [100000.0] * 64), (51, [-100000.0] * 64)]
    assert ordered(clusters(told(spark, far)).collect()) == ordered(plain(far, 8))
    with pytest.raises(Exception, match="beyond"):
        clusters(told(spark, [(1, [1e30] * 64)])).collect()


def test_dictionaries_are_lossless_and_read_once_a_code(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 3, (500, 7))
    centres = rng.integers(-9, 9, (4, 7))
    for width in (1, 2, 3, 7):
        entries, sizes, codes = encoded_chunk(rows, width)
        wide = [min(width, 7 - lo) for lo in range(0, 7, width)]
        assert all(s <= min(500, 6 ** w) for s, w in zip(sizes, wide, strict=True)) and len(entries) == sum(s * w for s, w in zip(sizes, wide, strict=True))
        row = {"ids": list(range(500)), "entries": entries, "sizes": sizes, "codes": codes.tobytes()}
        assert (distances(row, centres, width) == ((rows[:, None] - centres[None]) ** 2).sum(2)).all()
    table = chunks(vectors(told(spark, some(50))))
    assert sum(len(r["ids"]) for r in table.collect()) == 50
