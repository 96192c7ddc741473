"""Building the requests models are asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.ordered import lookup

# The system text of a scored question, and the seed pool.
HELPER = "You are a helpful assistant."
SEED_PROMPTS = (
    "Let's think step by step.",
    "Think about this logically.",
    "Solve this problem by breaking it down into smaller parts.",
    "Take a deep breath and work on this problem step-by-step.",
    "Please provide a detailed explanation followed by the final answer.",
)


def ask_all(items: DataFrame, prompts: list[str] | tuple[str, ...]) -> DataFrame:
    """Every item under every prompt of one pool, as ``prompt_pos`` and ``prompt``.

    The pool is a literal the rows are unfolded by: nothing is joined or moved.
    """
    pool = F.array(*[F.struct(F.lit(i).alias("prompt_pos"), F.lit(p).alias("prompt")) for i, p in enumerate(prompts)])
    return items.select("*", F.inline(pool))


def packed_pools(pools: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pool with its prompts in order; a pool holds a handful of prompts."""
    return pools.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("prompt_pos", "prompt"))).alias("_pool"))


def ask_pools(items: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Every item under every prompt of the pool with the same ``keys``."""
    met = lookup(items, packed_pools(pools, keys), keys, "inner")
    return met.select(*items.columns, F.inline("_pool"))


def request(prompt: Column, question: Column, placement: str) -> tuple[Column, Column]:
    """System and user text of a question asked under a prompt.

    ``pool`` puts the prompt before the question; ``system`` makes it the system text.
    """
    if placement == "pool":
        return F.lit(HELPER), F.concat(prompt, F.lit("\n\n"), question)
    if placement == "system":
        return prompt, question
    raise ValueError(f"unknown placement {placement!r}")


def with_request(df: DataFrame, placement: str = "pool", prompt: str = "prompt",
                 question: str = "question") -> DataFrame:
    system, user = request(F.col(prompt), F.col(question), placement)
    return df.withColumns({"system": system, "user": user})
