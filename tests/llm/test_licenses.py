"""Licence scans against brute force over all places."""

import random
import re

from promptmill.llm.licenses import BASE, BASE_SCORE, COVERAGE, NOTICES, scan, templates

SCHEMA = "doc_id long, text string, words string, hits int"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels, score, base = [], set(), 0.0, set()
    for t in templates():
        k = len(t.key)
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) == t.key:
                start = i - t.key_at
                covered = sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words)) / len(t.words)
                score = max(score, BASE_SCORE if t.base else covered)
                if t.base:
                    places.append(i)
                    base.add(t.label)
                if t.base or covered >= COVERAGE:
                    labels.add(t.label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(score, 9))


def texts():
    rng = random.Random(6)
    parts = [p for p, _ in BASE] + [n for n, _, _ in NOTICES] + [k for _, k, _ in NOTICES] + ["mit", "license", "cc", "by", "Wörter", "gnu", "é"]
    out = [None, "", " .,-", "MIT License", "the MIT\nLicense!", "mit licenseé", "KMIT license", "CC-BY-NC 4.0", "cc by cc by", "İcc by",
           "general public license version 3", "x" * 50_000]
    for _ in range(60):
        out.append("".join(rng.choice(parts) + rng.choice([" ", ". ", "\n", "-", ""]) for _ in range(rng.randrange(1, 9))).upper()
                   if rng.random() < 0.3 else " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))))
    return out


def test_matches_brute_force(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts())] + [(None, "mit license", "x", 1), (2, "mit license", None, 1), (2, "mit license", None, 1)]
    got = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0], r[1], r[5], str(r))
    assert sorted(((-1 if r.doc_id is None else r.doc_id, *r[1:7], round(r.score, 9)) for r in got), key=key) == sorted(
        ((-1 if i is None else i, *brute(t)) for i, t, *_ in rows), key=key)


def test_empty_table_and_plan(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = scan(spark.createDataFrame([(1, "mit license", None, None)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
