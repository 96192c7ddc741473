"""Reading answers, tagged blocks and prompts out of free text.

All of these are built-in Spark expressions; none runs Python per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Phrases that open a conclusion, in order of preference. Two longer
# ones that end in the first ("the answer is", "correct answer is") can never be reached.
CONCLUSIONS = ("answer is", "answer:", "option:", "choice:")
# Patterns.
NUMBER = r"-?\d+\.?\d*"
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BOXED = rf"(?i)\\boxed\{{{_SPACE}*([A-E]){_SPACE}*\}}"
IN_PARENS = r"\(([a-e])\)"
ALONE = r"(?<![\p{L}\p{N}_])([a-e])(?![\p{L}\p{N}_])"
SHORT_ANSWER = 10


def strip(text: Column) -> Column:
    """Python's ``str.strip()``: one pass, no regular expression."""
    return F.btrim(text, F.lit(WHITESPACE))


def _or_null(found: Column) -> Column:
    return F.nullif(found, F.lit(""))


def last_of(pattern: str) -> str:
    """The same pattern's last match. Anchored, so a miss costs one scan and not one per character."""
    return rf"(?s)\A.*{pattern}"


def last_number(text: Column) -> Column:
    """The last number of a text, thousands commas ignored; null when there is none."""
    hits = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.try_element_at(hits, F.lit(-1)).try_cast("double")


def loose_choice(text: Column) -> Column:
    """The last letter A-D anywhere in the text, inside words too."""
    return F.upper(_or_null(F.regexp_extract(text, last_of("([A-Da-d])"), 1)))


def _phrase(lowered: Column) -> Column:
    pick = F.lit(None).cast("string")
    for option in reversed(CONCLUSIONS):
        pick = F.when(F.contains(lowered, F.lit(option)), F.lit(option)).otherwise(pick)
    return pick


def _search(pattern: str) -> Callable[[Column, Callable[[str], Column]], Column]:
    return lambda text, was: F.when(was("phrase").isNotNull(), F.regexp_extract(was("tail"), pattern, 1)).otherwise(
        F.regexp_extract(was("tail"), last_of(pattern), 1))


def _letter(text: Column, was: Callable[[str], Column]) -> Column:
    short = F.when(F.length(strip(text)) < SHORT_ANSWER, F.regexp_extract(text, "[A-Ea-e]", 0))
    return F.upper(
        F.when(was("boxed") != "", was("boxed"))
        .when(was("parens") != "", was("parens"))
        .when(was("alone") != "", was("alone"))
        .otherwise(_or_null(short)))


#: Steps of reading a letter, in order: each takes the text and what the steps before it found.
_CHOICE_STEPS: dict[str, Callable[[Column, Callable[[str], Column]], Column]] = {
    "lowered": lambda text, was: F.lower(text),
    "phrase": lambda text, was: _phrase(was("lowered")),
    "tail": lambda text, was: F.coalesce(
        F.call_function("substring_index", was("lowered"), was("phrase"), F.lit(-1)), was("lowered")),
    "boxed": lambda text, was: F.regexp_extract(text, BOXED, 1),
    "parens": lambda text, was: F.when(was("boxed") == "", _search(IN_PARENS)(text, was)),
    "alone": lambda text, was: F.when(was("parens") == "", _search(ALONE)(text, was)),
    "letter": _letter,
}


def with_strict_choice(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the A-E letter a text settles on.

    A boxed letter wins. Otherwise the part after the last occurrence of the preferred
    conclusion phrase is read from its start, or a text without one from its end, for
    ``(X)`` and then for a letter standing alone. Very short texts fall back to their
    first letter A-E. Every step is a column of its own, so that each search runs once
    and only when the ones before it found nothing.
    """
    names = {step: out if step == "letter" else f"_{out}_{step}" for step in _CHOICE_STEPS}
    for step, found in _CHOICE_STEPS.items():
        df = df.withColumn(names[step], found(F.col(text), lambda earlier: F.col(names[earlier])))
    return df.drop(*[name for name in names.values() if name != out])


def strict_choices(texts: Column) -> Column:
    """The letters of an array of texts, read like :func:`with_strict_choice` reads one, each step once."""
    def taken(step: str) -> Callable[[Column], Column]:
        return lambda x: x.withField(step, _CHOICE_STEPS[step](x["text"], lambda earlier: x[earlier]))
    read = F.transform(texts, lambda x: F.struct(x.alias("text")))
    for step in _CHOICE_STEPS:
        read = F.transform(read, taken(step))
    return F.transform(read, lambda x: x["letter"])


def tag_pattern(tag: str, gap: str) -> str:
    return rf"(?is)<{tag}{gap}BEGIN>(.*?)</{tag}{gap}END>"


def _tag_bodies(text: Column, tag: str, gap: str) -> Column:
    return F.regexp_extract_all(text, F.lit(tag_pattern(tag, gap)), F.lit(1))


def tag_blocks_steps(text: Column, tag: str, out: str) -> list[dict[str, Column]]:
    """Columns that add ``out``, step by step, as :func:`with_tag_blocks` has it."""
    exact = f"_{out}_exact"
    chosen = F.when(F.size(exact) > 0, F.col(exact)).otherwise(_tag_bodies(text, tag, "[ _]"))
    return [{exact: _tag_bodies(text, tag, "_")},
            {out: F.coalesce(F.transform(chosen, strip), F.array().cast("array<string>"))}]


def with_tag_blocks(df: DataFrame, text: str, tag: str, out: str) -> DataFrame:
    """Add the trimmed bodies of ``<TAG_BEGIN>...</TAG_END>``; with a space for ``_`` if no exact one exists.

    The exact search is a column of its own: it runs once, and the second one only where it found nothing.
    """
    for step in tag_blocks_steps(F.col(text), tag, out):
        df = df.withColumns(step)
    return df.drop(f"_{out}_exact")


def generated_prompts(text: Column, count: int | None = None) -> Column:
    """Prompts of a model's list: one per line, without quotes or numbering; the first ``count``.

    Lines of up to ten characters and lines that open with "here" are talk, not prompts.
    """
    lines = F.transform(F.split(text, "\n"), strip)
    lines = F.filter(lines, lambda x: (F.length(x) > 10) & ~F.startswith(F.lower(x), F.lit("here")))
    lines = F.transform(lines, lambda x: F.btrim(F.btrim(x, F.lit('"')), F.lit("'")))
    lines = F.filter(lines, lambda x: F.length(x) > 0)

    def after_first(x: Column, mark: str) -> Column:
        return strip(F.regexp_replace(x, rf"(?s)\A[^{mark}]*[{mark}]", ""))

    numbered = r"\A[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
    lines = F.transform(
        lines, lambda x: F.when(F.rlike(x, F.lit(numbered)), after_first(after_first(x, "."), ")")).otherwise(x))
    return lines if count is None else F.slice(lines, 1, count)


def prompt_lines(text: Column) -> Column:
    """Prompts of a saved prompt file: its stripped, non-empty lines in order.

    A line that begins with a literal backslash and ``s`` letters loses that beginning.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: F.length(x) > 0)
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\A\\s*", ""))


def snippet(text: Column, size: int = 300) -> Column:
    """The first ``size`` characters, with an ellipsis only when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def label(text: Column, size: int = 100) -> Column:
    """The first ``size`` characters, always with an ellipsis."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def python_repr(text: Column) -> Column:
    """How Python prints the string inside a list."""
    escaped = text
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def choice_question(question: Column, choices: Column) -> Column:
    """``question``, up to four lettered choices and an open ``Answer:``, one per line."""
    lettered = [
        F.when(F.size(choices) > i, F.concat(F.lit(f"({letter}) "), F.get(choices, F.lit(i)), F.lit("\n")))
        for i, letter in enumerate("ABCD")
    ]
    return F.concat_ws("", question, F.lit("\n"), *lettered, F.lit("Answer:"))


def choice_letter(index: Column) -> Column:
    """Letter of a 0-based answer index; null outside A-D."""
    return F.get(F.array(*[F.lit(x) for x in "ABCD"]), index)


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` as text with two decimals, rounded half up from the exact ratio."""
    hundredths = F.floor((part * 20000 + whole) / (whole * 2))
    return F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"))
