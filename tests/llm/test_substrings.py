"""Substring dedup against a brute-force version."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.llm.common import named, word_names
from promptmill.llm.substrings import digests, filed, without_repeats

SCHEMA = "doc_id long, text string, symbol string, first int"


def brute(rows, window):
    first = {}
    lists = [(i if i is not None else -(1 << 63), (t or "").encode().split()) for i, t in rows]
    for i, w in lists:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in lists:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ñandú", "a"]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 12, 40, 200]))]
        for _ in range(rng.randrange(3)):
            lo = rng.randrange(60)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[lo:lo + rng.randrange(5, 90)]
        if i % 7 == 0:
            words[5:5] = ["a"] * rng.choice([9, 11, 12, 300])
        if i % 11 == 0:
            words += ["x", "y", "z"] * 30
        rows.append((i * 3, rng.choice([" ", "\n", "\t\x0b"]).join(words), "s", 1))
    return rows + [(1, rows[4][1], None, None), (1, rows[5][1] + " more", None, None), (None, rows[6][1], None, 2),
                   (500, None, None, None), (501, "", None, None), (502, " \n ", None, None), (503, "   ", "", 0)]


@pytest.mark.parametrize("window", [5, 12, 50])
def test_matches_brute_force(spark, window):
    rows = rows_of(window)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in without_repeats(docs, window=window).collect())
    assert got == brute([r[:2] for r in rows], window)


def test_empty_table(spark):
    assert digests(without_repeats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_passage_in_most_documents(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"own{i} {common} end{i % 3}", None, None) for i in range(300)]
    got = without_repeats(spark.createDataFrame(rows, SCHEMA)).groupBy("n_removed").agg(F.count("*").alias("n")).collect()
    # The 60 words of the passage go everywhere but in the first document; with the last word also windows to the end repeat.
    assert sum(r.n for r in got) == 300 and {r.n_removed for r in got} <= {0, 60, 61}
    assert sum(r.n for r in got if r.n_removed == 0) == 1


def test_equal_windows_are_filed_alike():
    rng = random.Random(3)
    passage = [b"p%d" % rng.randrange(9) for _ in range(120)]
    names = word_names()
    seen = {}
    for lead in range(8):
        text = b" ".join([b"q%d" % rng.randrange(5) for _ in range(30 + lead)] + passage + [b"end"] * lead)
        _, flat, at = named(names, [text])
        key, _, first, count = filed(flat, at, 50)
        for k, f, c in zip(key, first, count, strict=True):
            for p in range(f, f + c):
                if 30 + lead <= p <= 100 + lead:
                    assert seen.setdefault(p - 30 - lead, k) == k
    assert np.unique(list(seen.values())).size < 40


def test_rows_of_one_id_whose_texts_agree_in_crc32(spark):
    rows = _clashing()
    got = sorted(tuple(r) for r in without_repeats(spark.createDataFrame(rows, SCHEMA), window=5).collect())
    assert got == brute([r[:2] for r in rows], 5)


def _clashing():
    """Two texts of one id with the same crc32: one repeats an earlier passage, the other is of its own."""
    rng, passage, seen = random.Random(6), "a1 a2 a3 a4 a5 a6", {}
    for _ in range(200_000):
        text = f"{passage} {rng.getrandbits(96):024x}"
        seen[zlib.crc32(text.encode())] = text
    for _ in range(2_000_000):
        text = f"b1 b2 {rng.getrandbits(96):024x}"
        if zlib.crc32(text.encode()) in seen:
            return [(1, passage, None, None), (9, seen[zlib.crc32(text.encode())], None, None), (9, text, None, None)]
    raise AssertionError


def test_repeated_rows_take_linear_time(spark):
    """Many copies of one id and text, and of a text without an id, beside others that share their passages."""
    import time
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(150)] for _ in range(4)]
    shared = [" ".join([w for p in rng.sample(passages, 3) for w in [*p, *rng.choices(words, k=30)]]) for _ in range(6)]

    def took(copies):
        rows = [(i, t) for i, t in enumerate(shared)] + [(9, shared[-1])] * copies + [(None, shared[0])] * copies
        began = time.perf_counter()
        got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=50).collect()
        took = time.perf_counter() - began
        want = {(i if i is not None else -(1 << 63), n, gone, kept) for i, n, gone, kept in brute(rows[:6] + rows[6:7] + rows[-1:], 50)}
        assert {(r.doc_id if r.doc_id is not None else -(1 << 63), r.n_words, r.n_removed, r.kept) for r in got} == want and len(got) == len(rows)
        return took
    took(5)
    assert took(1000) < 12 * took(100) + 10
