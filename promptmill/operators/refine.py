"""Failed prompts, their rewrites, the verification of those, and item status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions import templates as tp
from promptmill.functions import text as tx
from promptmill.functions.grading import CORRECT, WRONG
from promptmill.operators.outcomes import ITEM

# Status names, notes and stand-in outputs.
SKIPPED = "Skipped (All Correct)"
NO_REWRITE = "Failed (Refine Step)"
NOT_VERIFIED = "Failed (Verification)"
SUCCESS = "Success"
NOTES = {NO_REWRITE: "No suggestions from optimizer", NOT_VERIFIED: "All candidates failed"}
OUTPUT_IF_VERIFIED, OUTPUT_IF_MISSING = "Correct", "No Output"
# Ours: an item none of whose calls came back.
NO_RESPONSE = "Failed (No Response)"


def in_order(column: str, sep: str, order: str) -> Column:
    """Texts of a group joined in order, empty when there are none."""
    return F.expr(f"coalesce(listagg({column}, '{sep}') within group (order by {order}), '')")


def failure_cases(graded: DataFrame, keys: list[str] = ITEM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per item with a wrong prompt: the cases shown to the optimizer and the list of prompts that worked.

    ``keep`` names columns that are the same in all rows of an item.
    """
    right, wrong = F.col("outcome") == CORRECT, F.col("outcome") == WRONG
    shown = graded.select(
        *keys, *keep, "prompt_pos",
        wrong.alias("_wrong"),
        F.when(wrong, tp.case_text(F.col("prompt"), tx.snippet(F.col("raw_output")))).alias("_case"),
        F.when(right, tx.python_repr(F.col("prompt"))).alias("_right"),
    )
    return shown.groupBy(*keys).agg(
        F.count_if("_wrong").alias("n_wrong"),
        in_order("_case", r"\n", "prompt_pos").alias("case_block"),
        F.concat(F.lit("["), in_order("_right", ", ", "prompt_pos"), F.lit("]")).alias("correct_list"),
        *[F.any_value(c).alias(c) for c in keep],
    ).where("n_wrong > 0")


def rewrite_requests(failures: DataFrame, items: DataFrame, template: str = tp.REWRITE_TEMPLATE,
                     keys: list[str] = ITEM) -> DataFrame:
    """One optimizer request per item with a wrong prompt."""
    asked = failures.join(items.select(*keys, "question", "answer"), keys)
    return asked.select(
        *keys, "n_wrong",
        tp.fill(F.lit(template), {tp.COUNT: F.col("n_wrong").cast("string")}).alias("system"),
        tp.rewrite_message(F.col("question"), F.col("answer"), F.col("case_block"), F.col("correct_list"))
        .alias("user"),
    )


def rewrite_pairs(outcomes: DataFrame, responses: DataFrame, tag: str = "REWRITE",
                  keys: list[str] = ITEM) -> DataFrame:
    """The i-th wrong prompt of an item with the i-th rewrite of its response; the shorter list decides."""
    rewrites = tx.with_tag_blocks(responses, "response", tag, "_rewrites").select(*keys, "_rewrites")
    met = outcomes.select(*keys, "wrong_prompts").join(rewrites, keys)
    size = F.least(F.size("wrong_prompts"), F.size("_rewrites"))
    zipped = F.arrays_zip(F.slice("wrong_prompts", 1, size).alias("old_prompt"),
                          F.slice("_rewrites", 1, size).alias("new_prompt"))
    return met.select(*keys, F.posexplode(zipped).alias("pair_pos", "_pair")).select(
        *keys, "pair_pos", F.col("_pair.old_prompt").alias("old_prompt"), F.col("_pair.new_prompt").alias("new_prompt"))


def check_candidates(checked: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    """Add ``verified`` and ``model_output`` to graded candidate outputs.

    A candidate is verified when any call with its text was right for that item. Its shown
    output is the last wrong one of that text, else a stand-in. Rows that are already
    partitioned by item are not moved.
    """
    same_text = Window.partitionBy(*keys, "new_prompt")
    wrong = F.col("outcome") == WRONG
    last_wrong = F.max_by(F.when(wrong, F.col("raw_output")), F.when(wrong, F.col("pair_pos"))).over(same_text)
    verified = F.bool_or(F.col("outcome") == CORRECT).over(same_text)
    return checked.withColumns({"verified": verified, "_last_wrong": last_wrong}).withColumn(
        "model_output", F.coalesce(
            "_last_wrong", F.when(F.col("verified"), OUTPUT_IF_VERIFIED).otherwise(OUTPUT_IF_MISSING))
    ).drop("_last_wrong")


def verified_pairs(candidates: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    return candidates.where("verified").select(*keys, "pair_pos", "old_prompt", "new_prompt")


def refinement_trace(candidates: DataFrame, keys: list[str] = ITEM, source: str = "subset") -> DataFrame:
    return candidates.select(
        *keys, "pair_pos", F.col(source).alias("source"), F.col("old_prompt").alias("original_prompt"),
        F.col("new_prompt").alias("candidate_prompt"), "verified", "model_output")


def status_of(n_correct: Column, n_wrong: Column, pairs: Column, verified: Column, compat: bool = False) -> Column:
    """Status of an item, the first rule that applies deciding."""
    none_wrong = F.when(n_correct > 0, SKIPPED).otherwise(SKIPPED if compat else NO_RESPONSE)
    return (
        F.when(n_wrong == 0, none_wrong)
        .when(pairs == 0, NO_REWRITE)
        .when(verified == 0, NOT_VERIFIED)
        .otherwise(SUCCESS)
    )


def note_of(status: Column) -> Column:
    note = F.lit("")
    for name, said in NOTES.items():
        note = F.when(status == name, said).otherwise(note)
    return note


def item_status(outcomes: DataFrame, candidates: DataFrame, keys: list[str] = ITEM, keep: tuple[str, ...] = (),
                compat: bool = False) -> DataFrame:
    """One status per item.

    ``compat`` counts an item none of whose calls came back as all correct.
    """
    tried = candidates.groupBy(*keys).agg(
        F.count("*").alias("_pairs"), F.count_if("verified").alias("_verified"))
    both = outcomes.select(*keys, *keep, "n_correct", "n_wrong").join(tried, keys, "left")
    pairs, verified = F.coalesce("_pairs", F.lit(0)), F.coalesce("_verified", F.lit(0))
    return both.select(
        *keys, *keep, status_of(F.col("n_correct"), F.col("n_wrong"), pairs, verified, compat).alias("status"),
        F.col("n_wrong").alias("initial_wrong"), verified.alias("verified_success"),
    ).withColumn("note", note_of(F.col("status")))


def status_funnel(status: DataFrame, source: str = "source") -> DataFrame:
    """Items per source and status with totals (null stands for all) and their share of the source."""
    counted = status.groupBy(source, "status").agg(
        F.count("*").alias("n"), F.sum("initial_wrong").alias("w"), F.sum("verified_success").alias("v"))
    totals = counted.rollup(source, "status").agg(
        F.sum("n").alias("n_items"), F.sum("w").alias("initial_wrong"), F.sum("v").alias("verified_success"),
        F.grouping_id().alias("_level"))
    # Totals only exist per source, so the windows run over an aggregated table.
    whole = F.max(F.when(F.col("_level") > 0, F.col("n_items"))).over(
        Window.partitionBy(source, F.col("_level") == 3))
    return totals.withColumn("share", F.col("n_items") / whole).drop("_level")
