"""Chunking rules as they arrive.

A run may hold a third of all rules, so its rules are not sent through one keyed state.
Each batch is chunked like a table, after the few rules and the count its runs carry over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptmill.operators.ordered import lookup, with_ordinal
from promptmill.operators.rules import tier1_chunks
from promptmill.workspace import dropped, written

_WAITING = "run_id long, item_id long, rule_text string, place long"
_MADE = "run_id long, n_chunks long"


def _carried(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Waiting rules (fewer than a chunk per run) and chunks made, as the given batch left them."""
    if batch_id < 0:
        return spark.createDataFrame([], _WAITING), spark.createDataFrame([], _MADE)
    return (spark.read.schema(_WAITING).parquet(f"{path}/waiting/batch={batch_id}"),
            spark.read.schema(_MADE).parquet(f"{path}/made/batch={batch_id}"))


def start_chunks(rules: DataFrame, path: str, checkpoint: str, group_size: int = 3, **trigger) -> StreamingQuery:
    """Emit a chunk whenever a run holds ``group_size`` rules, in order of arrival: by batch, then by item."""
    def chunk(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting, made = _carried(spark, path, batch_id - 1)
        # Places of a run go on from the rules that wait: first arrived, first chunked.
        held = waiting.groupBy("run_id").agg(F.count("*").alias("held"))
        came = written(batch.select("run_id", "item_id", "rule_text"), "batch")
        new = with_ordinal(came, ["run_id"], "item_id", "_new")
        new = lookup(new, held, ["run_id"]).withColumn("place", F.coalesce("held", F.lit(0)) + F.col("_new"))
        rows = written(waiting.unionByName(new.select(*waiting.columns)), "arrived")
        placed = lookup(tier1_chunks(rows, group_size, order="place"), made, ["run_id"]).withColumn(
            "chunk", F.col("chunk") + F.coalesce("n_chunks", F.lit(0))).drop("n_chunks")
        placed = written(placed, "placed")
        full = written(placed.where(~F.col("is_tail")), "chunks", f"{path}/chunks/batch={batch_id}")
        filled = written(full.groupBy("run_id").agg(F.count("*").alias("n_chunks")), "filled")
        used = F.coalesce("n_chunks", F.lit(0)) * group_size
        left = lookup(rows, filled, ["run_id"]).where(F.col("place") >= used).withColumn("place", F.col("place") - used)
        written(left.select(*waiting.columns), "waiting", f"{path}/waiting/batch={batch_id}")
        counts = made.unionByName(filled.select("run_id", "n_chunks")).groupBy("run_id").agg(
            F.sum("n_chunks").alias("n_chunks"))
        written(counts, "made", f"{path}/made/batch={batch_id}")
        for scratch in (came, rows, placed, filled):
            dropped(scratch)
    return (
        rules.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def all_chunks(spark: SparkSession, path: str, last_batch: int, group_size: int = 3) -> DataFrame:
    """Chunks made so far, closed by the tails of what still waits: a stream itself has no end."""
    done = spark.read.parquet(f"{path}/chunks").drop("batch")
    waiting, made = _carried(spark, path, last_batch)
    tails = lookup(tier1_chunks(waiting, group_size, order="place"), made, ["run_id"]).withColumn(
        "chunk", F.col("chunk") + F.coalesce("n_chunks", F.lit(0)))
    return done.unionByName(tails.select(*done.columns))
