"""Quality rules, lines first: bad lines go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import mapped

#: Fixed by contract: characters counted as symbols, the least words, the most words in repeated windows.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: A line goes for symbols in more than this share of its words, for this many bars, and, from so many words
#: on, for capitals in more than this share of its words, for fewer distinct words than this share, or for
#: no punctuation at all; and for standing above already.
SYMBOL_PERCENT, BARS, UPPER_PERCENT, DISTINCT_PERCENT = 30, 3, 60, 35
LONG_LINE = 10
_SYMBOL = re.compile(rb"\S*[#*$%&<>]\S*")
_CAPITALS = re.compile(rb"[A-Z][A-Z]")
_PUNCTUATION = re.compile(rb"[.,;:!?]")
#: A document goes when less than this share of its words stays.
KEPT_PERCENT = 50


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails: navigation, symbols, shouting, repetition or punctuation."""
    n = len(words)
    if line.count(b"|") >= BARS:
        return "navigation"
    if 100 * len(_SYMBOL.findall(line)) > SYMBOL_PERCENT * n:
        return "symbols"
    if n >= LONG_LINE:
        if _CAPITALS.search(line) and 100 * sum(w.isupper() and _CAPITALS.search(w) is not None for w in words) > UPPER_PERCENT * n:
            return "shouting"
        if 100 * len(set(words)) < DISTINCT_PERCENT * n:
            return "repetition"
        if not _PUNCTUATION.search(line):
            return "punctuation"
    return None


def measured(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, cleaned)."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = sum(len(w) for w in words) if text.isascii() else sum(len(w.decode()) for w in words)
    seen, duplicates, lost, stay = set(), 0, 0, []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                duplicates += 1
                lost += len(own)
                continue
            seen.add(line)
            if line_fails(line, own):
                lost += len(own)
                continue
        stay.append(line)
    windows = list(zip(*(words[k:] for k in range(REPEAT_WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + REPEAT_WINDOW - max(i, until)
                until = i + REPEAT_WINDOW
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
    kept = not failed and 100 * (n - lost) >= KEPT_PERCENT * n
    return (n, chars, sum(text.count(bytes([s])) for s in SYMBOLS), duplicates, repeated, failed, lost, kept, b"\n".join(stay).decode())


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures of every whole text, the verdict and the text without its bad lines.

    Null and blank texts have no words and fail. Rows are judged each for itself, repeated or not; null
    ids stay null; other columns are never read. A line that stood above already is removed as
    boilerplate; lines without words stay and cost nothing.
    """
    def piece(columns):
        ids, texts = columns
        return [ids, *zip(*(measured(t) for t in texts), strict=True)]

    return mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column)), piece,
                  "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                  "base_failed boolean, lost_words long, kept boolean, cleaned string")


def verdicts(docs: DataFrame) -> DataFrame:
    return cleaned(docs).drop("cleaned")
