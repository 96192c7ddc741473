"""Full runs: from items and a seed pool to one rule and new prompts per run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.operators import requests, rules
from promptmill.operators.ordered import lookup, with_ordinal
from promptmill.plans import merging, rounds
from promptmill.plans.steps import Models, Settings, generate, improve, merge
from promptmill.workspace import fresh_folder, written


@dataclass
class Run:
    """Result tables, all keyed by ``run_id``."""
    graded: DataFrame
    status: DataFrame
    candidates: DataFrame
    rules: DataFrame
    tier1: DataFrame
    merges: DataFrame
    pools: DataFrame
    final_rule: DataFrame
    final_prompts: DataFrame


def _finish(tier1: DataFrame, models: Models, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges above Tier-1, the rule they end in and the prompts made from it."""
    final, merges = merging.merge_all(tier1, models, settings)
    return merges, final, generate(final, ["run_id"], settings.output_prompts, models, settings)


def _seed_pools(items: DataFrame, prompts: list[str] | tuple[str, ...]) -> DataFrame:
    runs = items.select("run_id").distinct().withColumn("valid_from", F.lit(0).cast("long"))
    return requests.ask_all(runs, prompts)


def run_base(items: DataFrame, prompts: list[str] | tuple[str, ...], models: Models,
             settings: Settings = Settings()) -> Run:
    """Every item under the seed pool. Items are independent, so every step is one job over all of them."""
    done = improve(requests.ask_all(items, prompts), items, models, settings)
    chunks = written(rules.tier1_chunks(done.rules, settings.group_size), "chunks")
    tier1 = merging.merge_chunks(chunks, models, settings)
    merges, final, final_prompts = _finish(tier1, models, settings)
    return Run(done.graded, done.status, done.candidates, done.rules, tier1, merges, _seed_pools(items, prompts),
               final, final_prompts)


_POOL = "run_id long, valid_from long, prompt_pos int, prompt string"
_WAITING = "run_id long, item_id long, rule_text string"
_MADE = "run_id long, n_chunks long"


@dataclass
class Progress:
    """What one round hands to the next: pools in force, rules waiting for a chunk, chunks made per run.

    It holds at most a pool and ``group_size - 1`` rules per run, however many items went by.
    """
    pool: DataFrame
    waiting: DataFrame
    made: DataFrame

    @staticmethod
    def start(spark: SparkSession) -> Progress:
        return Progress(*[spark.createDataFrame([], schema) for schema in (_POOL, _WAITING, _MADE)])

    @staticmethod
    def after(spark: SparkSession, base: str, n: int) -> Progress:
        """As round ``n`` of the job in ``base`` left it."""
        return Progress(*[
            spark.read.schema(schema).parquet(f"{base}/progress/{name}/round={n}")
            for name, schema in (("pool", _POOL), ("waiting", _WAITING), ("made", _MADE))])


def play_round(todo: DataFrame, before: Progress, prompts: list[str] | tuple[str, ...], models: Models,
               settings: Settings, base: str, n: int, relaxed: bool) -> DataFrame:
    """Improve a block of items under the pools in force and leave round ``n`` in ``base``.

    Runs not seen before start with the seed ``prompts``. Returns, per run that filled a
    chunk, the item up to which the round counts and how many chunks it made. A round
    played again overwrites itself.
    """
    size, settings = settings.group_size, replace(settings, round=n)

    def kept_as(df: DataFrame, name: str) -> DataFrame:
        return written(df, name, f"{base}/{name}/round={n}")

    new_runs = todo.select("run_id").distinct().join(before.pool.select("run_id"), "run_id", "left_anti")
    seeds = written(_seed_pools(new_runs, prompts), "seeds")
    pool = before.pool.unionByName(seeds)
    # A relaxed round counts as a whole, so its large tables are written in their place at once.
    done = improve(requests.ask_pools(todo, pool, ["run_id"]), todo, models, settings, kept_as if relaxed else written)

    all_rules = written(before.waiting.unionByName(done.rules), "round-rules")
    filled = rules.tier1_chunks(all_rules, size).where(~F.col("is_tail"))
    if not relaxed:
        filled = filled.where("chunk = 0")
    filled = written(filled, "filled")
    last = written(filled.groupBy("run_id").agg(
        F.max("sample_idx").alias("last_item"), F.count("*").alias("made")), "last")
    texts = merge(filled, ["run_id", "chunk"], models, settings)
    earlier = F.coalesce("n_chunks", F.lit(0))
    placed = lookup(filled.drop("rules_block").join(texts, ["run_id", "chunk"]), before.made, ["run_id"])
    kept_as(placed.withColumn("chunk", F.col("chunk") + earlier).drop("n_chunks"), "tier1")

    def counted(rows: DataFrame) -> DataFrame:
        """All of the round, or a run's rows up to the item that filled its chunk."""
        if relaxed:
            return rows
        return lookup(rows, last.drop("made"), ["run_id"]).where(
            F.col("last_item").isNull() | (F.col("item_id") <= F.col("last_item"))).drop("last_item")

    kept_as(counted(done.rules), "rules")
    kept_as(counted(done.status), "status")
    if not relaxed:
        kept_as(counted(done.graded), "graded")
        kept_as(counted(done.candidates), "candidates")
    open_rules = lookup(counted(all_rules), last.drop("made"), ["run_id"]).where(
        F.col("last_item").isNull() | (F.col("item_id") > F.col("last_item"))).drop("last_item")
    kept_as(open_rules.select("run_id", "item_id", "rule_text"), "progress/waiting")

    newest = texts.groupBy("run_id").agg(F.max_by("rule_text", "chunk").alias("rule_text"))
    generated = generate(newest, ["run_id"], settings.iterative_prompts, models, settings)
    # In force from the item after the one that filled the chunk, or after the whole block.
    ends = todo.groupBy("run_id").agg(F.max("item_id").alias("last_item")) if relaxed else last
    starts = ends.select("run_id", (F.col("last_item") + 1).alias("valid_from"))
    fresh = written(generated.join(starts, "run_id").select("run_id", "valid_from", "prompt_pos", "prompt"), "fresh")
    kept_as(seeds.unionByName(fresh), "pools")
    # A run whose rule gave no prompt keeps its pool.
    kept_as(pool.join(fresh.select("run_id"), "run_id", "left_anti").unionByName(fresh), "progress/pool")
    counts = before.made.unionByName(last.select("run_id", F.col("made").alias("n_chunks")))
    kept_as(counts.groupBy("run_id").agg(F.sum("n_chunks").alias("n_chunks")), "progress/made")
    return last


def tables_of(spark: SparkSession, base: str, n: int) -> dict[str, DataFrame]:
    """The tables that rounds up to ``n`` left in ``base``."""
    if rounds.is_played(spark, base):
        return rounds.tables(spark, base, n)
    # A part of the job played again may have taken fewer rounds than before.
    return {name: spark.read.parquet(f"{base}/{name}").where(F.col("round") <= n).drop("round")
            for name in ("graded", "status", "candidates", "rules", "tier1", "pools")}


def finish_rounds(spark: SparkSession, base: str, n: int, models: Models, settings: Settings) -> Run:
    """Merge what still waits after round ``n`` as the tail, and the whole of ``base`` down to one rule per run."""
    done = tables_of(spark, base, n)
    if rounds.is_played(spark, base):
        waiting, made = rounds.left_of(spark, base, n)
    else:
        left = Progress.after(spark, base, n)
        waiting, made = left.waiting, left.made
    tail = lookup(rules.tier1_chunks(waiting, settings.group_size), made, ["run_id"])
    tail = written(tail.withColumn("chunk", F.col("chunk") + F.coalesce("n_chunks", F.lit(0))).drop("n_chunks"), "tail")
    tail = merging.merge_chunks(tail, models, settings)
    tier1 = written(done["tier1"].select(*tail.columns).unionByName(tail), "tier1")
    merges, final, final_prompts = _finish(tier1, models, settings)
    return Run(done["graded"], done["status"], done["candidates"], done["rules"], tier1, merges,
               done["pools"], final, final_prompts)


def run_iterative(items: DataFrame, prompts: list[str] | tuple[str, ...], models: Models,
                  settings: Settings = Settings(), block: int | None = None, relaxed: bool = False) -> Run:
    """Runs whose pool is replaced whenever a chunk of rules fills.

    All runs advance together, a block of items each per round, under their pool in force.
    A run keeps its items up to the one that fills its first chunk of the round and goes
    on after it with the new pool, which is exactly the one-item-at-a-time result whatever the
    block. A run's block starts at ``block`` (four chunks of rules if not given), doubles while no
    chunk fills, and else follows the items that the last chunk took, so that little work is done
    under a pool that is replaced meanwhile. With ``relaxed`` a run keeps whole blocks of ``block`` items (1,000)
    and takes the pool of its last chunk, for fewer rounds; results then depend on the block.
    """
    spark = items.sparkSession
    base = fresh_folder(spark, "iterative")
    n = play_items(items, prompts, models, settings, base, 0, block, relaxed)
    return finish_rounds(spark, base, n, models, settings)


def play_items(items: DataFrame, prompts: list[str] | tuple[str, ...], models: Models, settings: Settings, base: str, n: int,
               block: int | None = None, relaxed: bool = False) -> int:
    """Play rounds after round ``n`` of the job in ``base`` until ``items`` are used up; returns the last round's number.

    Items of a run are taken by their ids. Exact rounds are one job each (``plans.rounds``), unless answers or usage are
    kept by step.
    """
    block = block or (1000 if relaxed else 4 * settings.group_size)
    spark = items.sparkSession
    if not (relaxed or settings.answers or settings.usage_folder) and (n == 0 or rounds.is_played(spark, base)):
        return rounds.play_exactly(items, prompts, models, settings, base, n, block)
    progress = Progress.after(spark, base, n) if n else Progress.start(spark)
    # Numbered once and stored in that order, so that a round's scan reads only its part.
    numbered = with_ordinal(items, ["run_id"], "item_id").repartitionByRange("run_id", "ordinal") \
        .sortWithinPartitions("run_id", "ordinal")
    numbered = written(numbered, "numbered")
    cursor = written(numbered.groupBy("run_id").agg(
        F.lit(0).cast("long").alias("next"), F.count("*").alias("n_items"), F.lit(block).cast("long").alias("width")), "cursor")
    while True:
        low, high = cursor.where("next < n_items").agg(F.min("next"), F.max(F.col("next") + F.col("width"))).first()
        if low is None:
            return n
        n += 1
        todo = lookup(
            numbered.where((F.col("ordinal") >= low) & (F.col("ordinal") < high)),
            cursor.select("run_id", "next", "width"), ["run_id"], "inner",
        ).where((F.col("ordinal") >= F.col("next")) & (F.col("ordinal") < F.col("next") + F.col("width"))).drop("next", "width")
        todo = written(todo, "todo")
        last = play_round(todo.drop("ordinal"), progress, prompts, models, settings, base, n, relaxed)
        progress = Progress.after(spark, base, n)
        ends = F.least(F.col("next") + F.col("width"), F.col("n_items"))
        if relaxed:
            cursor = written(cursor.withColumn("next", ends), "cursor")
        else:
            reached = todo.select("run_id", F.col("item_id").alias("last_item"), "ordinal").join(
                last, ["run_id", "last_item"]).select("run_id", (F.col("ordinal") + 1).alias("after"))
            cursor = written(cursor.join(reached, "run_id", "left").select(
                "run_id", F.coalesce("after", ends).alias("next"), "n_items",
                F.coalesce(F.greatest(F.lit(block), (F.col("after") - F.col("next")) * 3 / 2).cast("long"), F.col("width") * 2).alias("width")),
                "cursor")
