"""Leaving a run's tables as the files of a run folder, for all runs at once.

Per-item detail is kept for the first and last items of a run only; status, merges,
pools, cost and final results are kept whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions import templates as tp
from promptmill.operators import pools as pl
from promptmill.operators import refine as rf
from promptmill.operators import rules as rl
from promptmill.operators.items import both_ends
from promptmill.operators.ordered import lookup
from promptmill.operators.outcomes import ITEM, item_result_map
from promptmill.operators.usage import cost_report
from promptmill.plans.improvement import Run
from promptmill.sources import results
from promptmill.workspace import written

# Titles in the rule log.
TITLES = {rl.TIER1: "Tier-1 Merge", rl.FOLD: "Recursive Merge", rl.TAIL: "Cleanup Tier-0",
          rl.CONVERGENCE: "Convergence Merge", rl.FINAL: "FINAL RULE"}
_AT_END = 2**62


#: What :func:`write_run` writes below its folder, one folder each.
TABLES = ("detailed_results", "refinement_trace", "prompt_history", "rule_evolution", "rules_history", "optimization_status",
          "optimized_prompts", "final_rule", "cost_report")


def detailed_items(items: DataFrame, size: int | None = 10) -> DataFrame:
    """The first and last ``size`` items of each run; all of them without a size."""
    if size is None:
        return items.select(*ITEM)
    return written(both_ends(items.select(*ITEM), ["run_id"], ["item_id"], size=size).select(*ITEM), "detailed")


def run_of(run: Run, items: DataFrame) -> Run:
    """The rows of the runs of ``items`` in every table, null a run like any other."""
    runs = written(items.select("run_id").distinct(), "own_runs")
    return replace(run, **{f.name: lookup(getattr(run, f.name), runs, ["run_id"], "inner") for f in fields(run)})


def detail_rows(run: Run, items: DataFrame, detailed: DataFrame) -> DataFrame:
    maps = item_result_map(run.graded.join(detailed, ITEM, "left_semi"))
    # Cut down first: the texts of other items are not moved.
    few = items.join(detailed, ITEM, "left_semi")
    return few.join(maps, ITEM).select(
        F.col("item_id").alias("id"), F.col("subset").alias("source"), "type", F.col("question").alias("q"), "res",
        "run_id")


def trace_rows(run: Run, detailed: DataFrame) -> DataFrame:
    return rf.refinement_trace(run.candidates.join(detailed, ITEM, "left_semi")).select(
        F.col("item_id").alias("id"), "source", "original_prompt", "candidate_prompt", "verified", "model_output",
        "run_id")


def _merge_rows(run: Run) -> DataFrame:
    """Every merge of every run with its place in the log: after its item, or at the end."""
    low = run.tier1.select(
        "run_id", F.when(F.col("is_tail"), rl.TAIL).otherwise(rl.TIER1).alias("tier"),
        F.when(F.col("is_tail"), rl.FINAL).otherwise(F.col("sample_idx").cast("string")).alias("sample_idx"),
        F.lit(0).alias("level"), F.col("chunk").alias("seq"), "rule_text")
    rows = low.unionByName(run.merges.select("run_id", "tier", "sample_idx", "level", "seq", "rule_text"))
    at = F.when(F.col("tier") == rl.TIER1, 1).when(F.col("tier") == rl.FOLD, 2)
    return rows.withColumn("block_no", F.coalesce(
        F.expr("try_cast(sample_idx as bigint)") * 4 + at,
        F.lit(_AT_END) + F.when(F.col("tier") == rl.TAIL, 0).otherwise(1 + F.col("level"))))


def evolution_rows(run: Run) -> DataFrame:
    return _merge_rows(run).select("sample_idx", "tier", F.col("rule_text").alias("rule_content"), "run_id")


def rule_log_rows(run: Run, detailed: DataFrame) -> DataFrame:
    """Blocks of the rule log: detailed items' rules, every merge, the final rule."""
    pairs = run.candidates.join(detailed, ITEM, "left_semi").where("verified").withColumn(
        "_pair", tp.refinement_text(F.col("old_prompt"), F.col("new_prompt")))
    samples = pairs.groupBy(*ITEM, "subset").agg(rf.in_order("_pair", r"\n", "pair_pos").alias("_pairs")).join(
        run.rules, ITEM).select(
        "run_id", (F.col("item_id") * 4).alias("block_no"),
        results.rule_block(
            F.concat(F.lit("Sample "), F.col("item_id").cast("string"), F.lit(" ("), "subset", F.lit(")")),
            tp.refinement_log(F.col("_pairs"), F.col("rule_text"))).alias("value"))
    title = F.lit("")
    for tier, said in TITLES.items():
        title = F.when(F.col("tier") == tier, said).otherwise(title)
    merges = _merge_rows(run).select("run_id", "block_no", results.rule_block(title, F.col("rule_text")).alias("value"))
    final = run.final_rule.select("run_id", F.lit(_AT_END + 10_000).alias("block_no"), results.rule_block(
        F.lit(TITLES[rl.FINAL]), F.col("rule_text")).alias("value"))
    return samples.unionByName(merges).unionByName(final)


def write_run(run: Run, items: DataFrame, folder: str, usage: DataFrame | None = None,
              models: dict[str, str] | None = None, detail_size: int | None = 10) -> None:
    """Write all files below ``folder``, replacing those of the runs of ``items`` only, whatever they left before.

    ``usage`` has the token usage of the runs' calls and ``models`` the model name per role. Detail is
    kept for the first and last ``detail_size`` items of a run, or for all of them. A reader may meet a run half
    written; :func:`promptmill.plans.publish.publish_run` shows readers whole runs only.
    """
    for table in TABLES:
        if table != "cost_report" or usage is not None:
            results.clear_runs(f"{folder}/{table}", items)
    write_tables(run, items, lambda table: f"{folder}/{table}", usage, models, detail_size)


def write_tables(run: Run, items: DataFrame, place: Callable[[str], str], usage: DataFrame | None = None,
                 models: dict[str, str] | None = None, detail_size: int | None = 10) -> None:
    """Write every table of ``TABLES`` to the folder that ``place`` gives it; the cost only with ``usage``."""
    run = run_of(run, items)
    detailed = detailed_items(items, detail_size)
    results.write_json(detail_rows(run, items, detailed), place("detailed_results"), restart=True)
    results.write_json(trace_rows(run, detailed), place("refinement_trace"), restart=True)
    results.write_json(pl.history_rows(run.pools), place("prompt_history"), restart=True)
    results.write_json(evolution_rows(run), place("rule_evolution"), restart=True)
    results.write_rule_log(rule_log_rows(run, detailed), place("rules_history"))
    status = run.status.withColumnRenamed("item_id", "id")
    results.write_csv(status.select("id", "source", "status", "initial_wrong", "verified_success", "note", "run_id"),
                      place("optimization_status"), restart=True)
    results.write_prompts(run.final_prompts, place("optimized_prompts"))
    results.write_final_rules(run.final_rule, place("final_rule"))
    if usage is not None:
        name = F.lit(None).cast("string")
        for role, model in (models or {}).items():
            name = F.when(F.col("role") == role, model).otherwise(name)
        report = cost_report(usage, ["run_id", "role"]).withColumns({"model": name, "ended": F.current_timestamp()})
        results.write_csv(results.cost_rows(report), place("cost_report"), restart=True)
