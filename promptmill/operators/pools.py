"""Which prompt pool was in force for which item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.operators.ordered import BUCKET, as_of, with_ordinal
from promptmill.operators.requests import ask_pools, packed_pools

# History events.
INITIAL, UPDATE = "initial_load", "iterative_update"


def pool_starts(chunks: DataFrame) -> DataFrame:
    """A pool made when a chunk fills is in force from the next item on."""
    return chunks.where(~F.col("is_tail")).select("run_id", (F.col("sample_idx") + 1).alias("valid_from"))


def pool_intervals(pools: DataFrame, width: int = BUCKET) -> DataFrame:
    """Each pool with the position it was replaced at (null: still in force).

    A run can have very many updates, so the next start is found by ordinal, not by a
    window over the run.
    """
    starts = pools.select("run_id", "valid_from").distinct()
    placed = with_ordinal(starts, ["run_id"], "valid_from", "pool_no", width)
    following = placed.select("run_id", (F.col("pool_no") - 1).alias("pool_no"), F.col("valid_from").alias("valid_to"))
    return placed.join(following, ["run_id", "pool_no"], "left")


def with_pool_start(items: DataFrame, pools: DataFrame, position: str = "item_id", width: int = BUCKET) -> DataFrame:
    """Add ``valid_from`` of the pool in force at every item. Updates that made no prompt are not in ``pools``."""
    return as_of(items, pools, ["run_id"], position, "valid_from", width)


def ask_pool_in_force(items: DataFrame, pools: DataFrame, position: str = "item_id",
                      width: int = BUCKET) -> DataFrame:
    """Every item under every prompt of the pool in force at it."""
    return ask_pools(with_pool_start(items, pools, position, width), pools, ["run_id", "valid_from"])


def history_rows(pools: DataFrame) -> DataFrame:
    """Pools in the layout of the prompt history file, with ``run_id``."""
    packed = packed_pools(pools, ["run_id", "valid_from"])
    first = F.col("valid_from") == 0
    return packed.select(
        "run_id",
        F.when(first, INITIAL).otherwise(UPDATE).alias("event"),
        F.when(first, F.col("valid_from")).otherwise(F.col("valid_from") - 1).alias("sample_idx"),
        F.transform("_pool", lambda p: p["prompt"]).alias("prompts"),
        F.when(~first, "Tier-1").alias("derived_from_rule_tier"),
        F.size("_pool").alias("count"),
    )
