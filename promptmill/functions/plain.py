"""What ``text``, ``grading``, ``templates`` and ``requests`` say as columns, said of one text in plain Python.

For steps that must follow one another inside a task. Patterns and formats are those of the columns; tests hold both to
the same values. A null is ``None``. Over all code points they differ only for letters and digits that one of Java's and
Python's Unicode tables has and the other has not yet (Java 17: those assigned after Unicode 13).
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

from promptmill.functions.grading import CORRECT, FAILED, TOLERANCE, WRONG
from promptmill.functions.templates import CASE, NUMBERED_RULE, PAIR
from promptmill.functions.text import BOXED, CONCLUSIONS, IN_PARENS, NUMBER, SHORT_ANSWER, last_of, tag_pattern

# Sent to executors as code, so that the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Java's patterns know ASCII only where they name no Unicode class, and look behind at half a character beyond U+FFFF.
_NUMBER, _BOXED, _SHORT = re.compile(NUMBER, re.A), re.compile(BOXED, re.A), re.compile("[A-Ea-e]")
_ALONE = r"(?<![^\W\U00010000-\U0010ffff])([a-e])(?!\w)"
_SEARCHES = [(re.compile(pattern), re.compile(last_of(pattern))) for pattern in (IN_PARENS, _ALONE)]
_REWRITES = [re.compile(tag_pattern("REWRITE", gap), re.A) for gap in ("_", "[ _]")]
_DIGITS = frozenset("²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")


def put(form: str, *texts: str | None) -> str | None:
    first, *rest = form.split("{}")
    if any(text is None for text in texts):
        return None
    return first + "".join(text + after for text, after in zip(texts, rest, strict=True))


def fill(template: str, values: dict[str, str]) -> str:
    for place, value in values.items():
        template = template.replace(place, value)
    return template


def request(system: str, prompt: str, question: str | None) -> tuple[str, str | None]:
    """A question asked under a prompt of the pool."""
    return system, put("{}\n\n{}", prompt, question)


def last_number(text: str | None) -> float | None:
    hits = _NUMBER.findall(text.replace(",", "")) if text is not None else None
    return float(hits[-1]) if hits else None


def _found(pattern: re.Pattern, text: str, group: int = 1) -> str:
    hit = pattern.search(text)
    return hit[group] if hit else ""


def strict_choice(text: str) -> str | None:
    lowered = text.lower()
    phrase = next((option for option in CONCLUSIONS if option in lowered), None)
    tail = lowered if phrase is None else lowered.rpartition(phrase)[2]
    letter = _found(_BOXED, text)
    for first, last in _SEARCHES:
        letter = letter or _found(last if phrase is None else first, tail)
    if not letter and len(text.strip()) < SHORT_ANSWER:
        letter = _found(_SHORT, text, 0)
    return letter.upper() or None


def outcome_of(given: str | None, answer: str | None, kind: str | None) -> str:
    """What the strict grader says."""
    if given is None:
        return FAILED
    truth = None if answer is None else answer.strip()
    if kind == "math":
        one, other = last_number(given), last_number(truth)
        right = one is not None and other is not None and abs(one - other) < TOLERANCE
    elif kind == "multiple_choice":
        right = truth is not None and strict_choice(given) == truth.upper()
    else:
        right = given.strip() == truth
    return CORRECT if right else WRONG


def snippet(text: str, size: int = 300) -> str:
    return f"{text[:size]}..." if len(text) > size else text


def python_repr(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    if "'" in text and '"' not in text:
        return f'"{escaped}"'
    return "'" + escaped.replace("'", "\\'") + "'"


def rewrites_in(text: str | None) -> list[str]:
    """Trimmed bodies of the rewrites; of those with a space for ``_`` if no exact one exists."""
    if text is None:
        return []
    found = _REWRITES[0].findall(text) or _REWRITES[1].findall(text)
    return [body.strip() for body in found]


def generated_prompts(text: str | None, count: int) -> list[str]:
    def after_first(line: str, mark: str) -> str:
        return (line.partition(mark)[2] if mark in line else line).strip()

    made = []
    for line in map(str.strip, text.split("\n") if text is not None else ()):
        if len(line) <= 10 or line.lower().startswith("here"):
            continue
        line = line.strip('"').strip("'")
        if line:
            numbered = line[0].isdecimal() or line[0] in _DIGITS
            made.append(after_first(after_first(line, "."), ")") if numbered else line)
    return made[:count]


def correct_list(prompts: list[str]) -> str:
    return f"[{', '.join(map(python_repr, prompts))}]"


def cases_text(wrong: list[tuple[str, str]]) -> str:
    """Prompts and their wrong outputs as they are shown to the optimizer."""
    return "\n".join(put(CASE, prompt, snippet(output)) for prompt, output in wrong)


def pairs_text(verified: list[tuple[str, str]]) -> str:
    return "\n".join(put(PAIR, old, new) for old, new in verified)


def rules_text(texts: list[str]) -> str:
    return "\n\n".join(put(NUMBERED_RULE, str(i), text) for i, text in enumerate(texts, 1))
