"""What graded outputs say about items, prompts and graders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions import text as tx
from promptmill.functions.grading import CORRECT, FAILED, WRONG

ITEM = ["run_id", "item_id"]


def item_outcomes(graded: DataFrame, keys: list[str] = ITEM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per item: its correct and wrong prompts in pool order, and how many of each outcome.

    A group is one item under one pool. ``keep`` names columns that are the same in all its rows.
    """
    def prompts(outcome: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.struct("prompt_pos", "prompt"))))
        return F.transform(pairs, lambda x: x["prompt"])
    return graded.groupBy(*keys, *keep).agg(
        prompts(CORRECT).alias("correct_prompts"),
        prompts(WRONG).alias("wrong_prompts"),
        F.count_if(F.col("outcome") == CORRECT).alias("n_correct"),
        F.count_if(F.col("outcome") == WRONG).alias("n_wrong"),
        F.count_if(F.col("outcome") == FAILED).alias("n_failed"),
    )


def item_result_map(graded: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    """Per item: map from prompt text to whether it was right; failed calls are left out.

    A text that is twice in the pool counts once, with its last position. Partitioning by
    item first lets both steps run on the same shuffle.
    """
    came_back = F.col("outcome") != FAILED
    once = (
        graded.repartition(*keys).groupBy(*keys, "prompt").agg(
            F.max_by(F.col("outcome") == CORRECT, F.when(came_back, F.col("prompt_pos"))).alias("ok"),
            F.max(F.when(came_back, F.col("prompt_pos"))).alias("pos"))
        .where("pos is not null")
    )
    entries = F.array_sort(F.collect_list(F.struct("pos", "prompt", "ok")))
    return once.groupBy(*keys).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["prompt"], e["ok"]))).alias("res"))


def prompt_accuracy(graded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correct answers per prompt, as a share of all its items and of those that came back."""
    keys = ["run_id", "prompt_pos", "prompt"] if keys is None else keys
    counted = graded.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == CORRECT).alias("correct"),
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") != FAILED).alias("answered"),
    )
    return counted.withColumns({
        "accuracy": F.col("correct") / F.col("total"),
        "accuracy_answered": F.try_divide(F.col("correct"), F.col("answered")),
    })


def prompt_leaderboard(accuracy: DataFrame, run: str = "run_id") -> DataFrame:
    """Rank of every prompt within its run, and whether it is the run's best.

    Works on the aggregated table, which has one row per run and prompt. Equal
    accuracies share a rank; the earliest prompt of the best is the run's best.
    """
    by_accuracy = Window.partitionBy(run).orderBy(F.col("accuracy").desc())
    first = Window.partitionBy(run).orderBy(F.col("accuracy").desc(), F.col("prompt_pos"))
    return accuracy.withColumns({
        "rank": F.rank().over(by_accuracy),
        "is_best": F.row_number().over(first) == 1,
    })


def grader_agreement(outputs: DataFrame, text: str = "raw_output") -> DataFrame:
    """How often each pair of letters was read by the strict and the loose grader."""
    read = tx.with_strict_choice(
        outputs.where((F.col("type") == "multiple_choice") & F.col(text).isNotNull()).select(text), text, "strict")
    return read.withColumn("loose", tx.loose_choice(F.col(text))).groupBy("strict", "loose").agg(
        F.count("*").alias("n"))
