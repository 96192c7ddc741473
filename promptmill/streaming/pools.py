"""Improving items as they arrive, with pools that change between and within batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from promptmill.plans.improvement import Progress, Run, finish_rounds, play_items, play_round
from promptmill.plans.steps import Models, Settings
from promptmill.workspace import dropped, written


def last_round(spark: SparkSession, path: str, batch_id: int) -> int:
    """The number of the last round that batches up to ``batch_id`` took; none before the first."""
    return 0 if batch_id < 0 else spark.read.schema("last_round int").parquet(f"{path}/batches/batch={batch_id}").first()[0]


def start_improving(items: DataFrame, prompts: list[str] | tuple[str, ...], models: Models, settings: Settings,
                    path: str, checkpoint: str, block: int | None = None, relaxed: bool = False, **trigger) -> StreamingQuery:
    """Play every batch of items as it arrives; :func:`finish_improving` closes the job.

    A batch takes as many rounds as its items fill chunks, so a pool is replaced at the same item as in
    ``run_iterative`` over all items in order of arrival (by batch, then by id), however they are cut into batches. Each batch
    notes its last round in ``path``; the next goes on from what that round left. A batch that runs
    again starts at the same round and overwrites what it left. With ``relaxed`` a batch is one round.
    """
    def improve(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = last_round(spark, path, batch_id - 1)
        came = written(batch, "batch")
        if relaxed:
            before = Progress.after(spark, path, done) if done else Progress.start(spark)
            play_round(came, before, prompts, models, settings, path, done + 1, True)
            done += 1
        else:
            done = play_items(came, prompts, models, settings, path, done, block)
        spark.createDataFrame([(done,)], "last_round int").write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        dropped(came)
    return (
        items.writeStream.foreachBatch(improve).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def finish_improving(spark: SparkSession, path: str, last_batch: int, models: Models, settings: Settings) -> Run:
    """Tables of all batches so far, the rules that wait merged as the tail, down to one rule a run."""
    return finish_rounds(spark, path, last_round(spark, path, last_batch), models, settings)
