"""Merging a run's rules down to one.

The merge tree is known beforehand (``operators.rules.merge_tree``), so merges run level
by level: one job merges a level of all runs at once. ``left_deep`` keeps the recorded
order, where each fold needs the one before, so a run is folded inside one task, some
hundreds of steps a job. ``balanced`` merges neighbours and takes a logarithm of that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from promptmill.functions import templates as tp
from promptmill.operators import rules as ops
from promptmill.operators.completion import REQUEST, Model, ask, call_usage
from promptmill.operators.ordered import lookup
from promptmill.operators.refine import in_order
from promptmill.plans.steps import OPTIMIZER, Models, Settings, merge
from promptmill.workspace import fresh_folder, written

_NODE = ["run_id", "tier", "seq"]


def merge_chunks(chunks: DataFrame, models: Models, settings: Settings) -> DataFrame:
    """Tier-1 merges, and the tail's, as ``run_id, chunk, rule_text`` with their chunk's columns."""
    texts = merge(chunks, ["run_id", "chunk"], models, settings)
    return written(
        chunks.drop("rules_block").join(texts, ["run_id", "chunk"]), "tier1")


def _block(parts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Numbered rule texts of a merge, in order of their place."""
    text = tp.numbered_rule(F.col(place), F.col("rule_text"))
    return parts.withColumn("_text", text).groupBy(*keys).agg(
        in_order("_text", r"\n\n", place).alias("rules_block"), F.count("*").alias("n_inputs"))


def merge_balanced(merged: DataFrame, models: Models, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Final rule per run and all merges above Tier-1 (``run_id, tier, level, seq, sample_idx, n_inputs, rule_text``)."""
    size = settings.group_size
    current = merged.select("run_id", F.col("chunk").alias("seq"), "rule_text")
    made = []
    level = 1
    while True:
        # Runs that are down to one rule pass through; the loop ends when all are.
        longest = current.agg(F.max("seq")).first()[0]
        if longest is None or longest == 0:
            return current.select("run_id", "rule_text"), _union(made, current.sparkSession)
        parts = current.withColumn("parent", F.floor(F.col("seq") / size)).withColumn(
            "place", F.col("seq") % size + 1)
        blocks = _block(parts, ["run_id", "parent"], "place")
        several = blocks.where("n_inputs > 1")
        texts = merge(several, ["run_id", "parent"], models, replace(settings, level=level))
        single = parts.join(blocks.where("n_inputs = 1").select("run_id", "parent"), ["run_id", "parent"]) \
            .select("run_id", "parent", "rule_text")
        made.append(texts.join(several.select("run_id", "parent", "n_inputs"), ["run_id", "parent"]).select(
            "run_id", F.lit(ops.CONVERGENCE).alias("tier"), F.lit(level).alias("level"), F.col("parent").alias("seq"),
            F.lit(ops.FINAL).alias("sample_idx"), "n_inputs", "rule_text"))
        current = written(
            texts.unionByName(single).withColumnRenamed("parent", "seq").select("run_id", "seq", "rule_text"),
            "level")
        level += 1


_MERGES = "run_id long, tier string, level int, seq long, sample_idx string, n_inputs long, rule_text string"


def _union(made: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame([], _MERGES)
    for more in made:
        out = out.unionByName(more)
    return out


#: What a folding task reads and leaves.
_FOLDED = ("run_id long, step long, tier string, seq long, rule_text string, tries int, error string, "
           "prompt_tokens long, completion_tokens long, asked_at timestamp")


def folded(rows: DataFrame, model: Callable[[], Model], settings: Settings) -> DataFrame:
    """Fold the texts of each run in order: (run_id, step, tier, seq, rule_text, ...) of every step.

    ``rows`` has ``run_id, step, place, tier, seq, rule_text``. A step's texts, after what the step before made, become one.
    A row of step 0 is what an earlier fold made. A run is one task's work, since each step needs the answer of the
    one before; the task holds the texts of one step at a time.
    """
    template, tries, delay = settings.merge_template, settings.max_tries, settings.retry_delay
    schema = to_arrow_schema(T.StructType.fromDDL(_FOLDED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, at, texts, carry = None, None, [], None

        def merged() -> list:
            nonlocal call, carry
            call = call or model()
            block = "\n\n".join(f"Rule {i}:\n{t}" for i, t in enumerate(texts if carry is None else [carry, *texts], 1))
            text, *rest = ask(call, template.replace(tp.RULES, block), tp.MERGE_MESSAGE, tries, delay, True)
            carry = text or ""
            return [*at, carry, *rest, datetime.now(timezone.utc)]

        def out(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, m, strict=True)) for m in made], schema=schema)

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                here = (row["run_id"], row["step"], row["tier"], row["seq"])
                if here != at:
                    if texts:
                        made.append(merged())
                    if at is None or here[0] != at[0]:
                        carry = None
                    at, texts = here, []
                if row["step"] == 0:
                    carry = row["rule_text"]
                else:
                    texts.append(row["rule_text"])
            if made:
                yield out(made)
        if texts:
            yield out([merged()])

    by_run = rows.repartition(*([settings.partitions] if settings.partitions else []), "run_id")
    return by_run.sortWithinPartitions("run_id", "step", "place").select("run_id", "step", "tier", "seq", "rule_text").mapInArrow(run, _FOLDED)


def _left(spark: SparkSession, folder: str) -> bool:
    """Whether a table was left whole in ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def merge_left_deep(merged: DataFrame, models: Models, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The same tables as :func:`merge_balanced`, in the order rules would be folded one by one.

    ``settings.fold_steps`` steps of every run are one job, which writes what it made; with ``settings.answers`` a
    job started again goes on after the last of these.
    """
    spark, size, span = merged.sparkSession, settings.group_size, settings.fold_steps
    tree = written(ops.merge_tree(merged, size), "tree")
    full = F.col("n_rules") == size
    done = merged.select(
        "run_id", F.when(full, ops.TIER1).otherwise(ops.TAIL).alias("tier"),
        F.when(full, F.col("chunk") + 1).otherwise(1).alias("seq"), "rule_text")
    folds = written(tree.where(F.col("tier") == ops.FOLD).groupBy("run_id").agg(F.max("seq").alias("folds")), "folds")
    # Texts of Tier-1 and the tail under the step they go into; what is left is merged one step after the last fold.
    # Written once and laid out by job, so that all jobs together read every text once.
    waiting = fresh_folder(spark, "fold-inputs")
    into = F.when(F.col("parent_tier") == ops.FOLD, F.col("parent_seq")).otherwise(F.coalesce("folds", F.lit(0)) + 1)
    (lookup(tree.where("parent_tier is not null").join(done, _NODE), folds, ["run_id"])
     .select("run_id", into.alias("step"), F.col("parent_place").alias("place"), F.col("parent_tier").alias("tier"),
             F.col("parent_seq").alias("seq"), "rule_text", F.floor((into - 1) / span).alias("job"))
     .hint("rebalance", "job").write.partitionBy("job").parquet(waiting))
    inputs = spark.read.schema("run_id long, step long, place long, tier string, seq long, rule_text string, job long").parquet(waiting)
    jobs = (folds.agg(F.max("folds")).first()[0] or 0) // span + 1
    base, made = f"{settings.answers}/folds" if settings.answers else fresh_folder(spark, "folds"), None
    for job in range(jobs):
        folder = f"{base}/job={job}"
        if not _left(spark, folder):
            rows = inputs.where(F.col("job") == job).drop("job")
            if made is not None:
                carried = made.groupBy("run_id").agg(F.max_by("rule_text", "step").alias("rule_text")).select(
                    "run_id", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("tier"),
                    F.lit(None).cast("long").alias("seq"), "rule_text")
                rows = rows.unionByName(carried)
            folded(rows, models.optimizer, settings).write.mode("overwrite").parquet(folder)
        made = spark.read.schema(_FOLDED).parquet(folder)
        if settings.usage_folder:
            named = made.withColumn(REQUEST, F.sha2(F.to_json(F.struct("run_id", "tier", "seq"), {"ignoreNullFields": "false"}), 256))
            call_usage(named, OPTIMIZER, settings.optimizer_name, "folds", settings.round, job).write.mode("overwrite").parquet(
                f"{settings.usage_folder}/folds-{settings.round}-{job}")
    steps = spark.read.schema(_FOLDED).parquet(*[f"{base}/job={job}" for job in range(jobs)])
    done = written(done.unionByName(steps.select("run_id", "tier", "seq", "rule_text")), "done")
    final = tree.where(F.col("parent_tier").isNull()).select(*_NODE).join(done, _NODE).select("run_id", "rule_text")
    made = tree.where(F.col("tier").isin(ops.FOLD, ops.CONVERGENCE)).join(done, _NODE).select(
        "run_id", "tier", F.lit(0).alias("level"), "seq", "sample_idx", "n_inputs", "rule_text")
    return final, made


def merge_all(merged: DataFrame, models: Models, settings: Settings) -> tuple[DataFrame, DataFrame]:
    by_order = {"balanced": merge_balanced, "left_deep": merge_left_deep}
    return by_order[settings.merge_order](merged, models, settings)
