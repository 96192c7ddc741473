"""Spelling variants against edit distances worked out plainly."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from promptmill.llm import spelling
from promptmill.llm.spelling import near_pairs, slices, variants

SCHEMA = "doc_id long, text string, word string, n string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3 and len(w) >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def some(seed, letters="abÀ", docs=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    return [(i, " ".join(rng.choices(pool, [1 + k % 7 for k in range(len(pool))], k=rng.randrange(1, 60))).replace(" b", ", B")) for i in range(docs)]


def found(spark, rows):
    return sorted(map(tuple, variants(spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("block, filled", [(1024, 256), (3, 2)])
def test_equals_plain(spark, monkeypatch, block, filled):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "FILLED", filled)
    rows = some(1) + [(None, "abbbb abbbb Abbbb, aBbbb"), (None, None), (3, ""), (4, "12 ,"), (5, "abbba " * 20), (5, "abbba " * 20)]
    want = plain(rows)
    assert len(want) > 50 and any(w[2] != w[0] for w in want) and max(w[4] for w in want) > 3
    assert found(spark, rows) == want


def test_chains_are_followed_to_the_last(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 5}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    got = {r[0]: r for r in found(spark, rows)}
    assert sorted(got.values()) == plain(rows)
    assert got["aaaaa"][2] == "abbbb" and got["zzzzz"][1] is None and got["zzzzz"][4] == 1


def test_empty_tables_and_texts_without_words(spark):
    assert found(spark, [(1, None), (2, "one two")]) == []
    assert variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text_and_word(spark):
    long = "hello world " * 200_000
    word = "ab" * 100_000
    rows = [(1, long), (2, f"{word} {word}"), (3, f"{word} {word[:-1]} {word[:-1]} {word[:-1]}")]
    got = {r[0]: r for r in found(spark, rows)}
    assert got["hello"][3] == 200_000 and got[word][3] == 3 and got[word][4] == 1 and got[word[:-1]][4] == 1


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "aé ab, abcdefghijk!! ÿÿÿÿÿÿÿÿÿ x" * 3
    parts = list(slices(text))
    assert "".join(parts) == text and len(parts) > 5
    assert [w for p in parts for w in spelling._RUN.findall(p)] == spelling._RUN.findall(text)


def test_tiles_against_edit_distance():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((6, 7)))) for _ in range(300)})
    matrix = np.array([list(w.ljust(7).encode()) for w in words], np.uint8)
    pairs = set()
    for side in ("prefix", "suffix"):
        once = set(zip(*(x.tolist() for x in near_pairs(7, side, matrix, None)), strict=True))
        assert not pairs & once
        pairs |= once
        split = set(zip(*(x.tolist() for x in near_pairs(7, side, matrix[:100], matrix[100:])), strict=True))
        assert split == {(i, j - 100) for i, j in once if i < 100 <= j}
    assert pairs == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and 7 in (len(a), len(b)) and one_edit(a, b)}
