"""Grading free-text outputs against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions import text as tx

TOLERANCE = 1e-6
CORRECT, WRONG, FAILED = "correct", "wrong", "failed"


def _same_number(output: Column, answer: Column) -> Column:
    return F.abs(tx.last_number(output) - tx.last_number(answer)) < TOLERANCE


def _outcome(given: Column, truth: Column, kind: Column, letter: Column) -> Column:
    right = (
        F.when(kind == "math", _same_number(given, truth))
        .when(kind == "multiple_choice", letter == F.upper(truth))
        .otherwise(tx.strip(given) == truth)
    )
    return F.when(given.isNull(), FAILED).when(F.coalesce(right, F.lit(False)), CORRECT).otherwise(WRONG)


def grade(df: DataFrame, grader: str = "strict", output: str = "raw_output",
          answer: str = "answer", kind: str = "type", out: str = "outcome") -> DataFrame:
    """Add ``correct``, ``wrong`` or ``failed`` (no output came back) to every row.

    ``math`` compares numbers, ``multiple_choice`` the letter read by the chosen
    grader, and any other type the stripped strings. An output nothing can be read
    from is wrong.

    Aggregate or window over the outcome rather than filter by it: a filter is pushed below
    the columns it reads and grades every row a second time. Failed calls are dropped
    by their missing output (:func:`came_back`), which costs nothing.
    """
    if grader not in ("strict", "loose"):
        raise ValueError(f"unknown grader {grader!r}")
    given, truth = F.col(output), tx.strip(F.col(answer))
    letter = f"_{out}_letter"
    # Only choice outputs need a letter: the others skip the text work.
    probe = f"_{out}_probe"
    staged = df.withColumn(probe, F.when(F.col(kind) == "multiple_choice", given))
    if grader == "strict":
        staged = tx.with_strict_choice(staged, probe, letter)
    else:
        staged = staged.withColumn(letter, tx.loose_choice(F.col(probe)))
    outcome = _outcome(given, truth, F.col(kind), F.col(letter))
    return staged.withColumn(out, outcome).drop(probe, letter)


def graded_all(outputs: Column, answer: Column, kind: Column) -> Column:
    """What :func:`grade` says with its strict grader of every output in an array, all of one item."""
    truth = tx.strip(answer)
    letters = F.when(kind == "multiple_choice", tx.strict_choices(outputs)).otherwise(
        F.transform(outputs, lambda x: F.lit(None).cast("string")))
    return F.zip_with(outputs, letters, lambda given, letter: _outcome(given, truth, kind, letter))


def came_back(outputs: DataFrame, output: str = "raw_output") -> DataFrame:
    """Outputs of calls that did not fail."""
    return outputs.where(F.col(output).isNotNull())
