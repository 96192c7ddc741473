"""Token accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.ordered import BUCKET, with_running_sums

# USD per million tokens, in and out.
PRICES = {"scorer": ("0.00", "0.00"), "optimizer": ("2.50", "10.00")}


def _seconds(usage: DataFrame, ts: str) -> Column:
    """Whole seconds that never run backwards: by the wall clock for times without a zone, else by the instant."""
    if usage.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_seconds(ts)
    days = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def running_usage(usage: DataFrame, width: int = BUCKET) -> DataFrame:
    """Tokens used so far per run and role at every call, in time and then call order."""
    seconds = _seconds(usage, "ts")
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return with_running_sums(
        usage.withColumn("total_tokens", total), ["run_id", "role"], seconds, ["ts", "call_id"],
        {"prompt_so_far": "prompt_tokens", "completion_so_far": "completion_tokens", "total_so_far": "total_tokens"},
        width)


def token_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def with_cost(totals: DataFrame, prices: dict[str, tuple[str, str]] = PRICES) -> DataFrame:
    """Add ``est_cost`` in USD, exact to five decimals. A role without a price costs nothing.

    Prices are parameters of the job, so they are literals in the plan and not a join.
    """
    def priced(tokens: str, side: int):
        price = F.lit("0").cast("decimal(10,4)")
        for role, both in prices.items():
            price = F.when(F.col("role") == role, F.lit(both[side]).cast("decimal(10,4)")).otherwise(price)
        return F.col(tokens).cast("decimal(20,0)") * price
    cost = (priced("input_tokens", 0) + priced("output_tokens", 1)) / F.lit(1_000_000)
    return totals.withColumn("est_cost", cost.cast("decimal(18,5)"))


def cost_report(usage: DataFrame, keys: list[str], prices: dict[str, tuple[str, str]] = PRICES) -> DataFrame:
    return with_cost(token_totals(usage, keys), prices)
