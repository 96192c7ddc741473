"""Kneser-Ney models against the formulas worked out plainly, and held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from promptmill.llm import languages
from promptmill.llm.languages import ORDER, fit, grams_of, predicted, words_of

SCHEMA = "doc_id long, text string, lang string, score double"


def brute(words):
    """p(last character | those before) by interpolated Kneser-Ney over the words of one language."""
    level = Counter(g for w in words for g in grams_of(w))
    own, backoff = {}, {}
    for k in range(ORDER, 0, -1):
        n1, n2 = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2 + 1e-9)))
        totals, types = Counter(), Counter()
        for g, c in level.items():
            totals[g[:-1]] += c
            types[g[:-1]] += 1
        own.update({g: (c - d) / totals[g[:-1]] for g, c in level.items()})
        backoff.update({h: d * types[h] / t for h, t in totals.items()})
        level = Counter(g[1:] for g in level)
        level.pop("", None)

    def p(gram):
        if not gram:
            return 1 / 256
        return own.get(gram, 0.0) + backoff.get(gram[:-1], 1.0) * p(gram[1:])
    return p


def documents():
    rng = random.Random(8)
    syllables = {"aa": ["an", "ti", "sho", "ber"], "bb": ["ou", "ê", "le", "ti"], "cc": ["wxy", "an", "za", "ou"]}
    rows = []
    for i in range(120):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text.capitalize() + ". 12!", lang, None))
    return rows


def test_bits_follow_the_formulas(spark):
    rows = documents()
    model = fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["aa", "bb", "cc"]
    by_lang = defaultdict(list)
    for _, text, lang, _ in rows:
        by_lang[lang] += words_of(text.encode())
    grams = grams_of("anti") + grams_of("zzz") + grams_of("ouê")
    got = model.bits(grams)
    for j, lang in enumerate(model.langs):
        p = brute(by_lang[lang])
        assert got[:, j] == pytest.approx([-np.log2(max(p(g), 1e-12)) for g in grams], rel=1e-5, abs=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents() + [(900, None, "aa", None), (901, "", None, None), (902, "12 ² !", "bb", None), (None, "anti shober", None, None),
                          (903, "anti shober", None, 1.0), (1, "anti shober", "aa", None), (1, "anti shober", "aa", None)]
    got = predicted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    right = [r.lang_pred == "abc"[r.doc_id % 3] * 2 for r in got if r.held_out and r.doc_id is not None and 1 < r.doc_id < 120]
    assert len(right) > 15 and np.mean(right) > 0.95


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "some text", None, None)], SCHEMA)
    assert [r.lang_pred for r in predicted(docs).collect()] == ["und"] and predicted(docs.limit(0)).count() == 0


def test_unseen_grams_take_no_value_of_others(spark):
    """Grams whose crc32 agrees with a seen one's in its first 21 bits."""
    def cut(gram):
        return zlib.crc32(f"aa|{gram}".encode()) >> 11

    words = ["anti", "shober", "berti", "shoan"]
    seen = {cut(g) for w in words for g in grams_of(w)}
    rng = random.Random(4)
    tried = ("".join(rng.choice("cdfgjklmpquvwxyzäöüß") for _ in range(ORDER)) for _ in range(10 ** 6))
    clash = [g for g in tried if cut(g) in seen][:3]
    assert clash
    p = brute(words)
    model = fit(spark.createDataFrame([(1, " ".join(words), "aa", None)], SCHEMA))
    assert model.bits(clash)[:, 0] == pytest.approx([-np.log2(p(g)) for g in clash], rel=1e-5)


def test_words_that_no_task_holds_are_joined(spark, monkeypatch):
    rows = documents() + [(None, "anti shober", None, None), (1, "anti shober", "aa", None), (1, "anti shober", "aa", None), (902, "12 ² !", "bb", None), (903, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    results = []
    for held in (languages.HELD_VALUES, 9):
        monkeypatch.setattr(languages, "HELD_VALUES", held)
        got = predicted(docs).collect()
        results.append(sorted((r.doc_id or -1, r.held_out, r.lang_pred, round(r.score, 9), r.rejected, round(r.bits_per_char, 9)) for r in got))
    assert len(results[0]) == len(rows) and results[0] == results[1]


def test_scores_of_texts_follow_the_formulas(spark):
    """Bits per character of whole texts, and which language is taken, against sums worked out plainly."""
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs)
    by_lang = defaultdict(list)
    for _, text, lang, _ in rows:
        by_lang[lang] += words_of(text.encode())
    plain = {lang: brute(words) for lang, words in by_lang.items()}
    texts = {i: f"{text} zebra Ünder 4th" for i, text, _, _ in rows[:30]}
    got = languages.scored(spark.createDataFrame([(i, t, None, None) for i, t in texts.items()], SCHEMA), model).collect()
    assert len(got) == 30
    for r in got:
        grams = [g for w in words_of(texts[r.doc_id].encode()) for g in grams_of(w)]
        bits = {lang: sum(-np.log2(max(p(g), 1e-12)) for g in grams) / len(grams) for lang, p in plain.items()}
        assert r.lang_pred == min(bits, key=bits.get) and r.bits_per_char == pytest.approx(min(bits.values()), rel=1e-6)
        weight = {lang: 2 ** (-model.sharpness * (b - min(bits.values()))) for lang, b in bits.items()}
        assert r.score == pytest.approx((0.5 if r.rejected else 1) / sum(weight.values()), rel=1e-5)


def test_very_long_words_and_texts(spark):
    rows = documents() + [(500, "anti" * 250_000, "aa", None), (501, "anti shober " * 200_000, None, None), (503, "ouê" * 300_000, None, None)]
    got = {r.doc_id: r.lang_pred for r in predicted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[500] == got[501] == "aa" and got[503] != "und"


def test_costs_are_whole_numbers_whatever_is_held(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), SCHEMA)
    results = []
    for held, memo in ((languages.HELD_VALUES, languages.MEMO_WORDS), (60, 5)):
        monkeypatch.setattr(languages, "HELD_VALUES", held)
        monkeypatch.setattr(languages, "MEMO_WORDS", memo)
        results.append(sorted(map(tuple, predicted(docs).collect())))
    assert results[0] == results[1]


def test_every_left_out_text_calibrates(spark):
    """More texts than any fixed number, the unlikely ones among the longest: limit and sharpness against all of them, plainly."""
    rng = random.Random(3)
    told = [("aa" if i % 2 else "bb", [rng.randrange(1, 9) * languages.STEPS * (50 if i > 990 else 1), rng.randrange(1, 9) * languages.STEPS, 1 + i % 3])
            for i in range(1000)] + [("cc", [1, 1, 1]), ("aa", [0, 0, 0])]
    model = languages.calibrated(languages.Model(["aa", "bb"]), spark.createDataFrame(told, "key string, total array<long>").repartition(5))
    kept = [(["aa", "bb"].index(k), np.array(t[:2]) / languages.STEPS / t[2]) for k, t in told if k != "cc" and t[2]]
    own = np.array([b[k] for k, b in kept])
    assert model.limit == pytest.approx(np.quantile(own, 1 - languages.REJECTED_SHARE) + own.std(), rel=1e-6)
    loss = {2.0 ** e: np.mean([np.log(np.exp2(np.clip(-2.0 ** e * (b - b[k]), -1000, 1000)).sum()) for k, b in kept]) for e in range(-2, 7)}
    assert model.sharpness == min(loss, key=loss.get)


def test_long_and_late_texts_count_for_the_limit(spark):
    """A fold of more than 400 texts, some beyond 20,000 characters and of rare letters: each raises the limit."""
    usual = [(i, "anti shober berti", "aa") for i in range(500)]
    odd = [(600 + i, "anti shober " * 1_700 + "qxzj vkwq " * 1_700, "aa") for i in range(3)]
    limits = []
    for rows in (usual, usual + odd):
        told = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        counts = languages.gram_counts(spark.createDataFrame(usual, told.schema).select("lang", "text")).unionByName(
            languages.gram_counts(told.selectExpr("cast(null as string) lang", "text")))
        limits.append(languages.learned(told, languages.written(counts, "counts"))[0].limit)
    assert limits[1] > 3 * limits[0]


@pytest.mark.parametrize("words", [{}, {"a": 2, "abca": 3, "\u00e9t\u00e9": 1, "b" * 50: 2 ** 40}, {chr(0x4e00 + i) + "x": i + 1 for i in range(5000)}])
def test_grams_of_many_words_are_counted_at_once(words):
    want, got = Counter(), Counter()
    for word, n in words.items():
        for gram in grams_of(word):
            want[gram] += n
    for gram, n in languages.counted(words):
        got[gram] += n
    assert got == want
