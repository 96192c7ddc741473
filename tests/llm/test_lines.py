"""Line-first quality rules against plain statements of the measures."""

import random
import re

from promptmill.llm.lines import cleaned, measured

SCHEMA = "doc_id long, text string, kept boolean, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "é" * 30, "a b c d e " * 12, "x\n\nx\nx \n", "\x0b".join("abcdefghijkl"), "a b c d " * 9]
    words = ["the", "cat", "sat.", "On", "ÉTÉ", "a|b", "***", "WORD", "#x", "日本"]
    for _ in range(80):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(0, 60))))
    return out


def test_measures_match_brute_force():
    for text in texts():
        assert measured(None if text is None else text.encode())[:6] == brute(text), text


def test_rows(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts())] + [(None, "x", True, None), (3, "one", None, "7"), (3, "one", None, "7")]
    got = cleaned(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in got) == want
    assert cleaned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_verdicts_and_cleaned_text():
    good = "A plain line of prose, with some words in it and an end.\nAnother one follows here, much like the first of them.\n" \
        + "\n".join(f"Line {c} goes on {c}{c} about {c}x and {c}y until its stop." for c in "pqrstuv")
    menu = "Home | News | Sports | Weather | About"
    kept = measured(f"{good}\n{menu}\n{good.splitlines()[3]}".encode())
    assert kept[7] and kept[8] == good
    for bad in (menu, "buy*** now$$$ cheap%%% pills### here&&& today*** only$$$", "ALL OF THIS IS SHOUTED AT YOU WITHOUT ANY PAUSE OR END",
                "word " * 30, "no marks at all in this rather long line of many words that goes on"):
        assert not measured(f"{bad}\n{good.splitlines()[0][:20]}.".encode())[7], bad
    assert measured(good.encode())[7] and not measured(b"too short.")[7]
