"""Token totals and cost that follow a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptmill.operators.usage import token_totals, with_cost
from promptmill.workspace import deleted, finished

#: After so many batches their changes are folded into one table of all keys.
FOLD_BATCHES = 16
_BATCH, _TOTALS = "changes-", "totals-"


def start_totals(usage: DataFrame, keys: list[str], path: str, checkpoint: str, fold_batches: int = FOLD_BATCHES,
                 **trigger) -> StreamingQuery:
    """Keep token totals per ``keys``; every batch leaves the totals that changed.

    Calls are added up before the shuffle, so a busy role is a few rows per task. A batch
    that runs again overwrites its own folder. Every ``fold_batches`` batches the latest totals of all keys become
    one table, and what only the table before needed goes: at most two tables and twice as many batches
    stay, however long the stream runs.
    """
    def leave(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/{_BATCH}{batch_id}")
        if (batch_id + 1) % fold_batches == 0:
            _fold(batch.sparkSession, keys, path, batch_id)
    return (
        token_totals(usage, keys).writeStream.outputMode("update").foreachBatch(leave)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    return sorted(int(name.removeprefix(kind)) for name in finished(spark, path) if name.startswith(kind))


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int, list[str]]:
    """The number of the last table of totals (before ``upto``; -1 for none), and the folders that tell all totals."""
    tables = [n for n in _numbers(spark, path, _TOTALS) if upto is None or n < upto]
    base = tables[-1] if tables else -1
    since = [n for n in _numbers(spark, path, _BATCH) if n > base and (upto is None or n <= upto)]
    return base, [f"{path}/{_TOTALS}{n}" for n in tables[-1:]] + [f"{path}/{_BATCH}{n}" for n in since]


def _latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    values = ["input_tokens", "output_tokens", "total_tokens", "batch"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def _fold(spark: SparkSession, keys: list[str], path: str, batch_id: int) -> None:
    """Fold all up to ``batch_id`` into a table. Its sources stay until the next one, so that it can be played again."""
    base, parts = _parts(spark, path, batch_id)
    _latest(spark.read.parquet(*parts), keys).write.mode("overwrite").parquet(f"{path}/{_TOTALS}{batch_id}")
    for kind, last in ((_BATCH, base), (_TOTALS, base - 1)):
        for n in _numbers(spark, path, kind):
            if n <= last:
                deleted(spark, f"{path}/{kind}{n}")


def current_cost(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest totals of every key, with their cost: from the last table of totals and the batches since."""
    _, parts = _parts(spark, path)
    return with_cost(_latest(spark.read.parquet(*parts), keys).drop("batch"))
