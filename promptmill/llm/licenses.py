"""Licence scans by a positional rare-token index, in built-in functions only.

Notices are templates of words, each with a mandatory key phrase. How many documents hold each licence
word gives its IDF; a template is filed under the word of its key phrase with the highest one, since a
file that holds the phrase holds that word. A file's rare licence words are looked up; every
place proposes the template's start there (its own place less the posting's), the template's words are
compared at these relative positions, and the key phrase must stand in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels that every scan reports.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Wording of common licence notices, with the key phrase that has to be there, and labels of the method's own.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2", "license as published by the free software foundation", "gpl-notice"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gnu affero general public license", "affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "cc-attribution"),
    ("released under the mit license", "under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd-text"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain", "unlicense"),
)

#: Share of a notice's words that have to stand at their places for its label, and the score of a base phrase alone.
COVERAGE, BASE_SCORE = 0.75, 0.9

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), 0, tuple(p.split()), True) for p, label in BASE]
    for notice, key, label in NOTICES:
        words, phrase = tuple(notice.split()), tuple(key.split())
        at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
        out.append(Template(label, words, at, phrase, False))
    return out


def words_of(text: Column) -> Column:
    """Words of a text, lowered in A-Z: runs of digits, letters and anything beyond ASCII.

    The two letters beyond ASCII whose lower case is an ASCII letter are put aside first; other letters may
    change too, but to letters beyond ASCII, which no template has.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    return F.split(F.lower(plain), _SEPARATORS)


def _trimmed(parts: str) -> str:
    """Without the empty parts that separators at either end of a text leave."""
    a, b = f"int({parts}[0] = '')", f"int(size({parts}) > 1 and {parts}[size({parts}) - 1] = '')"
    return f"slice({parts}, {a} + 1, greatest(0, size({parts}) - {a} - {b}))"


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def document_frequencies(docs: DataFrame, text_column: str = "text") -> dict[str, int]:
    """In how many documents each licence word stands; at most one row per word comes to the driver."""
    vocabulary = sorted({w for t in templates() for w in t.words})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text_column)), _array(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every whole text.

    ``places`` lists label, word place and coverage of every phrase found. Null and empty texts have no words,
    no labels and score 0. Rows are scanned each for itself, repeated or not; null ids stay null;
    other columns are never read. The index has one entry per template, whatever the corpus.
    """
    frequency = document_frequencies(docs, text_column)
    postings, anchors = [], set()
    for t in templates():
        # The rarest word of the key phrase; of equally rare ones the first.
        k = min(range(len(t.key)), key=lambda i: (frequency.get(t.key[i], 0), i))
        anchors.add(t.key[k])
        postings.append(F.struct(F.lit(t.key[k]).alias("word"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
                                 F.lit(t.key_at + k).alias("at"), F.lit(t.key_at).alias("key_at"), _array(t.key).alias("key"), _array(t.words).alias("words")))
    index, rare = F.array(*postings), _array(sorted(anchors))

    def propose(place: Column, words: Column) -> Column:
        def judged(p: Column) -> Column:
            start = place["i"] - p["at"]
            phrase = F.slice(words, F.greatest(start + p["key_at"], F.lit(0)) + 1, F.size(p["key"]))
            skipped = F.greatest(-start, F.lit(0))
            there = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size(p["words"]) - skipped, F.lit(0)))
            same = F.zip_with(there, F.slice(p["words"], skipped + 1, F.size(p["words"])), lambda a, b: F.when(a == b, 1).otherwise(0))
            covered = F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(p["words"])
            return F.struct(p["label"].alias("label"), p["base"].alias("base"), (start + p["key_at"]).alias("place"),
                            F.when((start + p["key_at"] >= 0) & (phrase == p["key"]), covered).otherwise(0.0).alias("coverage"))
        return F.transform(F.filter(index, lambda p: p["word"] == place["word"]), judged)

    named = (docs.select(F.col(id_column).cast("long").alias("doc_id"), words_of(F.col(text_column)).alias("parts"))
             .select("doc_id", F.expr(_trimmed("parts")).alias("words")))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(anchors)), F.struct(i.alias("i"), w.alias("word")))),
                      lambda x: x.isNotNull())
    found = F.filter(F.flatten(F.transform(places, lambda x: propose(x, F.col("words")))), lambda h: h["coverage"] > 0)
    none = F.array().cast("array<struct<label: string, base: boolean, place: int, coverage: double>>")
    hits = named.select("doc_id", F.size("words").cast("long").alias("n_words"),
                        F.when(F.arrays_overlap("words", rare), found).otherwise(none).alias("hits"))
    base = "filter(hits, h -> h.base)"
    full = f"filter(hits, h -> h.base or h.coverage >= {COVERAGE})"
    return hits.selectExpr(
        "doc_id", "n_words", f"cast(size({base}) as long) as n_base",
        f"cast(array_min({base}.place) as long) as first_word", f"cast(array_max({base}.place) as long) as last_word",
        f"array_join(array_sort(array_distinct({base}.label)), ',') as base_labels",
        f"array_join(array_sort(array_distinct({full}.label)), ',') as labels",
        f"coalesce(array_max(transform(hits, h -> if(h.base, {BASE_SCORE}D, h.coverage))), 0D) as score",
        "transform(hits, h -> struct(h.label, h.place, h.coverage)) as places")


def scan(docs: DataFrame) -> DataFrame:
    return scanned(docs).drop("places")
