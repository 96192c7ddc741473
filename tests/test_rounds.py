"""Rounds of exact iterative runs: one job each, and an item's calls in lists read as they are in rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from promptmill.functions.grading import grade, graded_all
from promptmill.operators.completion import list_completer
from promptmill.plans import improvement
from promptmill.plans.steps import Models
from promptmill.workspace import fresh_folder
from tests.test_plans import MODELS, PAIRS, SEEDS, items  # noqa: F401


def test_a_round_takes_few_jobs(spark, items):  # noqa: F811
    """A run takes a round a chunk, so that jobs a round decide how long it takes. Steps that were jobs of their own took some dozens."""
    base, sc = fresh_folder(spark, "few-jobs"), spark.sparkContext
    sc.setJobGroup("few-jobs", "rounds")
    try:
        n = improvement.play_items(items, SEEDS, MODELS, PAIRS, base, 0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert n > 3
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) <= 10 * n + 30


def _ruled():
    """Models under which every item gives a rule."""
    def scorer(system, user):
        return "(A)" if "Better" in system + user else "(B)"

    def optimizer(system, user):
        return "<REWRITE_BEGIN>Better one</REWRITE_END>" if user.startswith("[TASK CONTEXT]") else "Think about all things"
    return Models(lambda: scorer, lambda: optimizer)


def test_a_chunk_takes_one_round(spark, items):  # noqa: F811
    """A block that followed the items of the last round alone was short wherever a chunk ended early in it: then every chunk took rounds again."""
    base, settings, n = fresh_folder(spark, "few-rounds"), replace(PAIRS, group_size=4), 0
    some = items.where("run_id = 0 and item_id < 48").withColumns({"type": F.lit("multiple_choice"), "answer": F.lit("A")})
    # In two parts: the second goes on with the block of the first.
    for part in ("item_id < 24", "item_id >= 24"):
        n = improvement.play_items(some.where(part), SEEDS, _ruled(), settings, base, n, block=1)
    assert improvement.tables_of(spark, base, n)["tier1"].count() == 4
    # Blocks of one, two and four items up to the first chunk.
    assert n == 3 + 3


def test_a_round_is_the_same_on_any_number_of_tasks(spark, items):  # noqa: F811
    few = items.where("item_id < 30")
    said = []
    for settings in (PAIRS, replace(PAIRS, partitions=3)):
        base = fresh_folder(spark, "tasks")
        n = improvement.play_items(few, SEEDS, MODELS, settings, base, 0)
        done = improvement.tables_of(spark, base, n)
        said.append({name: sorted(map(str, done[name].collect())) for name in ("graded", "candidates", "status", "rules", "tier1", "pools")})
    assert said[0] == said[1] and said[0]["tier1"]


def test_exact_tables_are_those_kept_by_step(spark, items, tmp_path):  # noqa: F811
    """With usage kept by step the rounds are jobs of single steps; the tables are the same, null runs too."""
    some = items.where("item_id < 36").withColumn("run_id", F.expr("nullif(run_id, 1)"))
    said = []
    for settings in (PAIRS, replace(PAIRS, usage_folder=f"{tmp_path}/usage")):
        base = fresh_folder(spark, "by-step")
        done = improvement.tables_of(spark, base, improvement.play_items(some, SEEDS, MODELS, settings, base, 0))
        said.append({name: sorted(map(str, (r for r in done[name].select(sorted(done[name].columns)).collect()))) for name in done})
    # The steps join runs by equality, which loses a null run; its rows are in the one-job rounds only.
    known = [{name: [r for r in rows if "run_id=None" not in r] for name, rows in tables.items()} for tables in said]
    assert known[0] == known[1]
    assert any("run_id=None" in r for r in said[0]["status"])


ODD = ["", "  A ", "b", None, "The answer is (c). Not (E)", "so \\boxed{ d } it is (a)", "answer: nothing here", "Answer is A answer is", "1,234.5 or 12",
       "-3.", "no number", "I think (b) or e", "option: (z) choice: d", "E" * 12, " yes ", "x\nThe ANSWER IS\n(B)\n", "12"]


@pytest.mark.parametrize("kind, answer", [("multiple_choice", "b"), ("multiple_choice", "E"), ("math", "so 12"), ("math", None), ("general", " yes"),
                                          (None, "12"), ("multiple_choice", None)])
def test_lists_are_graded_as_rows(spark, kind, answer):
    rows = spark.createDataFrame([(i, o, answer, kind) for i, o in enumerate(ODD)], "i int, raw_output string, answer string, type string")
    want = [r.outcome for r in grade(rows).orderBy("i").collect()]
    one = spark.createDataFrame([(ODD, answer, kind)], "outputs array<string>, answer string, type string")
    assert one.select(graded_all(F.col("outputs"), F.col("answer"), F.col("type"))).first()[0] == want


def test_lists_are_asked_in_their_row(spark):
    def model():
        def answer(system, user):
            if user == "never":
                raise ConnectionError("no")
            return (f" {system}{user} ", 3, 4)
        return answer
    asked = spark.createDataFrame(
        [(1, [("s", "a"), ("s", "never")]), (2, []), (3, None)], "id long, requests array<struct<system string, user string>>")
    got = {r.id: [tuple(a) for a in r.answers] for r in asked.select("id", list_completer(lambda: model(), retry_delay=0.0)("requests").alias("answers")).collect()}
    assert got == {1: [("sa", 1, None, 3, 4), (None, 3, "ConnectionError: no", None, None)], 2: [], 3: []}
