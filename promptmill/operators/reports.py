"""Held-out reports, run catalogs and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions import text as tx
from promptmill.functions.names import TIME, run_parts
from promptmill.operators.ordered import lookup

# Fixed value: the line between report blocks.
RULE = "-" * 30
# Fixed value: the result line of a report block.
RESULT = r"Prompt #(\d+) Accuracy: (\d+\.\d+)% \((\d+)/(\d+)\)"


def report_blocks(accuracy: DataFrame, headers: DataFrame, run: str = "run_id") -> DataFrame:
    """Text blocks of each run's report: block 0 is its header, then one per prompt in order.

    ``headers`` holds ``model``, ``split`` and ``subjects`` (as shown) per run.
    """
    top = headers.select(run, F.lit(0).cast("long").alias("block"), F.concat(
        F.lit("Evaluation Report\nModel: "), "model", F.lit("\nData Split: "), "split", F.lit(" (Full)\nSubjects: "),
        "subjects", F.lit("\n\n")).alias("text"))
    number = F.col("prompt_pos") + 1
    body = accuracy.select(run, number.cast("long").alias("block"), F.concat(
        F.lit("Prompt #"), number.cast("string"), F.lit(" Accuracy: "), tx.percent(F.col("correct"), F.col("total")),
        F.lit("% ("), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"),
        F.lit(")\nPrompt: "), tx.label(F.col("prompt")), F.lit("\n" + RULE + "\n")).alias("text"))
    return top.unionByName(body)


def report_lines(blocks: DataFrame, run: str = "run_id") -> DataFrame:
    """The same reports line by line."""
    lines = blocks.select(run, "block", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines


def parsed_reports(blocks: DataFrame) -> DataFrame:
    """Accuracy rows out of report blocks read back (``path``, ``value``)."""
    found = F.regexp_extract_all("value", F.lit(RESULT), F.lit(1))
    def field(i: int):
        return F.regexp_extract("value", RESULT, i)
    return blocks.where(F.size(found) > 0).select(
        "path", field(1).cast("int").alias("prompt_no"), field(2).cast("double").alias("percent"),
        field(3).cast("long").alias("correct"), field(4).cast("long").alias("total"),
        F.regexp_extract("value", r"\nPrompt: (.*)\n", 1).alias("label"))


def run_catalog(paths: DataFrame, prompts: DataFrame) -> DataFrame:
    """Pieces of every run's name, and whether it has any prompt; ``prompts`` has ``path`` per prompt."""
    with_prompts = prompts.select("path").distinct().withColumn("has_prompts", F.lit(True))
    return paths.join(with_prompts, "path", "left").select(
        "path", *run_parts(F.col("path")), F.coalesce("has_prompts", F.lit(False)).alias("has_prompts"))


def evaluable_runs(paths: DataFrame, prompts: DataFrame) -> DataFrame:
    """Runs that have a prompt to evaluate."""
    return paths.join(prompts.select("path").distinct(), "path", "left_semi")


def with_training_run(evaluated: DataFrame, runs: DataFrame) -> DataFrame:
    """Held-out results with the run that made their prompts.

    Both sides have the pieces of their names (``functions.names.run_parts``). Names differ
    between the two, but the time a run started is in both.
    """
    pieces = [c for c in runs.columns if c in evaluated.columns and c != "started"]
    return evaluated.join(runs.drop(*pieces), "started")


#: Pieces of a name that both sides must share for :func:`with_nearest_run`.
AGREE = ("target_model", "optimizer_model", "limit", "mode")


def with_nearest_run(evaluated: DataFrame, runs: DataFrame, key: str, tolerance: int = 5,
                     agree: tuple[str, ...] = AGREE) -> DataFrame:
    """Held-out results with the run that started nearest to the time in their names, ``tolerance`` seconds away at most.

    Both sides have the pieces of their names; those of ``agree`` must be the same (null meets null). A dataset or
    subset label that one side lacks, as older names do, agrees with any; where both have one it must be the same. Of
    runs equally far the earlier counts, then the least in the order of its other columns. ``key`` tells the rows of ``evaluated``
    apart; rows without a run stay out. Times are dealt into slots of the tolerance, and a run stands in its own and
    both beside it, so the join is by equality and its work follows the runs that are close in time.
    """
    def seconds(column: str):
        return F.unix_timestamp(F.try_to_timestamp(column, F.lit(TIME)))
    width = max(tolerance, 1)
    own = [c for c in runs.columns if c not in evaluated.columns]
    left = evaluated.withColumn("_at", seconds("started")).withColumn("_slot", F.floor(F.col("_at") / width))
    right = runs.select(
        F.struct(seconds("started").alias("at"), *(F.col(c) for c in own)).alias("_run"), *(F.col(c).alias(f"_r_{c}") for c in {*agree, "dataset", "subset_label"}))
    right = right.withColumn("_near", F.explode(F.sequence(
        F.floor(F.col("_run.at") / width) - 1, F.floor(F.col("_run.at") / width) + 1)))
    same = F.col("_slot") == F.col("_near")
    for c in agree:
        same &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    for c in ("dataset", "subset_label"):
        same &= F.coalesce(F.col(c) == F.col(f"_r_{c}"), F.lit(True))
    away = F.abs(F.col("_at") - F.col("_run.at"))
    # Only the key and the run are grouped; the result itself comes back by its key.
    found = (left.select(key, "_at", "_slot", *{*agree, "dataset", "subset_label"}).join(right, same).where(away <= tolerance)
             .groupBy(key).agg(F.min(F.struct(away.alias("away"), "_run")).alias("_best")))
    return lookup(evaluated, found.select(key, *(F.col(f"_best._run.{c}").alias(c) for c in own), F.col("_best.away").alias("seconds_away")), [key], "inner")


def run_scores(accuracy: DataFrame, run: str = "run_id") -> DataFrame:
    return accuracy.groupBy(run).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.max("accuracy").alias("best_accuracy"),
        F.max_by("prompt", F.struct("accuracy", -F.col("prompt_pos"))).alias("best_prompt"))


def run_comparison(scores: DataFrame, runs: DataFrame, group: str, run: str = "run_id") -> DataFrame:
    """Lift of iterated over base runs of the same ``group``; ``runs`` has ``mode`` per run."""
    tagged = lookup(scores, runs.select(run, group, "mode"), [run], "inner")
    def of(mode: str, column: str):
        return F.avg(F.when(F.col("mode") == mode, F.col(column)))
    return tagged.groupBy(group).agg(
        of("Base", "mean_accuracy").alias("base_mean"), of("Iter", "mean_accuracy").alias("iter_mean"),
        of("Base", "best_accuracy").alias("base_best"), of("Iter", "best_accuracy").alias("iter_best"),
    ).withColumns({
        "mean_lift": F.col("iter_mean") - F.col("base_mean"), "best_lift": F.col("iter_best") - F.col("base_best")})
