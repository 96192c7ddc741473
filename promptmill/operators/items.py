"""Question items: normalising, choosing subsets, slicing, counting, numbering."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions import text as tx
from promptmill.operators.ordered import lookup, with_ordinal
from promptmill.workspace import written

# Fixed values.
CHOICE_SOURCE = "mmlu_"
MATH_SOURCE = "gsm8k"
DEFAULT_SUBSET = "high_school_mathematics"
ALL_SUBSETS = "all"
NOT_SUBSETS = ("all", "auxiliary_train")
DEFAULT_TYPE, DEFAULT_SOURCE = "general", "unknown"

# Stands for a null position, which comes before all others.
_FIRST = -(1 << 62)


def choice_items(raw: DataFrame) -> DataFrame:
    """Multiple-choice rows as items. An index outside A-D leaves the answer null."""
    return raw.select(
        "pos",
        tx.choice_question(F.col("question"), F.col("choices")).alias("question"),
        tx.choice_letter(F.col("answer")).alias("answer"),
        F.lit("multiple_choice").alias("type"),
        F.concat(F.lit(CHOICE_SOURCE), "subset").alias("source"),
    )


def math_items(raw: DataFrame) -> DataFrame:
    return raw.select("pos", "question", "answer", F.lit("math").alias("type"), F.lit(MATH_SOURCE).alias("source"))


def held_out_items(raw: DataFrame) -> DataFrame:
    """Multiple-choice rows under the column names of held-out evaluation."""
    return raw.select(
        "pos",
        tx.choice_question(F.col("question"), F.col("choices")).alias("question"),
        tx.choice_letter(F.col("answer")).alias("ground_truth"),
        F.lit("multiple_choice").alias("type"),
        F.col("subset").alias("subject"),
    )


def answerable(items: DataFrame, answer: str = "answer") -> DataFrame:
    """Items whose answer could be read."""
    return items.where(F.col(answer).isNotNull())


def unanswerable(items: DataFrame, answer: str = "answer") -> DataFrame:
    """The quarantined rest of :func:`answerable`."""
    return items.where(F.col(answer).isNull())


def with_defaults(items: DataFrame) -> DataFrame:
    return items.withColumns({
        "type": F.coalesce("type", F.lit(DEFAULT_TYPE)),
        "source": F.coalesce("source", F.lit(DEFAULT_SOURCE)),
    })


def requested_subsets(requested: str | Iterable[str] | None) -> list[str] | None:
    """Subset names of a request; ``None`` stands for all of them."""
    names = requested.split(",") if isinstance(requested, str) else list(requested or [])
    names = [n for n in (n.strip() for n in names) if n]
    if ALL_SUBSETS in names:
        return None
    return names or [DEFAULT_SUBSET]


def filter_subsets(items: DataFrame, requested: str | Iterable[str] | None, subset: str = "subset") -> DataFrame:
    """Rows of the requested subsets; names nothing is stored under select nothing.

    The names are part of the request, so they become a predicate the scan can use.
    """
    names = requested_subsets(requested)
    if names is None:
        return items.where(~F.col(subset).isin(*NOT_SUBSETS))
    return items.where(F.col(subset).isin(*names))


def slice_subsets(items: DataFrame, limit: int | None, offset: int = 0, subset: str = "subset",
                  position: str = "pos") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of every subset by position; no limit means all from the offset.

    Positions are distinct within a subset; a null one comes first, and a null subset is one like any other.
    Only they are ranked: the bounds of each subset's
    slice come out as one row, and the items themselves are neither sorted nor moved.
    """
    unlimited = limit is None or limit <= 0
    if unlimited and offset == 0:
        return items
    last = offset if unlimited else offset + limit
    at = F.coalesce(F.col(position).cast("long"), F.lit(_FIRST))
    ranked = with_ordinal(items.select(subset, at.alias("_at")), [subset], "_at", "_rank").withColumn("_rank", F.col("_rank") + 1)
    bounds = ranked.where(F.col("_rank") <= last).groupBy(subset).agg(
        F.max(F.when(F.col("_rank") <= offset, F.col("_at"))).alias("_low"), F.max("_at").alias("_high"))
    met = lookup(items, written(bounds, "bounds"), [subset], "inner")
    kept = met.where(F.col("_low").isNull() | (at > F.col("_low")))
    if not unlimited:
        kept = kept.where(at <= F.col("_high"))
    return kept.drop("_low", "_high")


def load_counts(items: DataFrame, subset: str = "subset") -> DataFrame:
    """Rows per subset, and in all (null subset). The totals add up counts, not rows."""
    counted = items.groupBy(subset).agg(F.count("*").alias("n"))
    return counted.rollup(subset).agg(F.sum("n").alias("n_items"))


def with_item_index(items: DataFrame, subset: str = "subset", position: str = "pos",
                    width: int | None = None) -> DataFrame:
    """Add ``item_index``, 0-based over all subsets in name order, and ``n_total``.

    Ordinals within a subset are bucketed; only one row per subset is ever put in
    a single order.
    """
    numbered = with_ordinal(items, [subset], position, "_ordinal", **({"width": width} if width else {}))
    sizes = items.groupBy(subset).agg(F.count("*").alias("_n"))
    in_order = Window.orderBy(subset)
    starts = sizes.select(
        subset,
        F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_total"),
    )
    return (
        lookup(numbered, starts, [subset], "inner")
        .withColumn("item_index", F.col("_start") + F.col("_ordinal"))
        .drop("_ordinal", "_start")
    )


def both_ends(rows: DataFrame, keys: list[str], order: list[str], index: str = "item_index", size: int = 10) -> DataFrame:
    """Rows among the first or last ``size`` of their group, with their 0-based ``index`` in it.

    Nothing is numbered but what is kept: each task cuts its rows down to ``size`` a group and end before
    any are moved. ``order`` tells the rows of a group apart; null keys are a group, null values come first.
    """
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ways = {"first": [F.asc(c) for c in order], "last": [F.desc(c) for c in order]}
    first, last = (rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*way))).where(F.col("_r") <= size)
                   for way in ways.values())
    last = lookup(last, written(totals, "totals"), keys, "inner").withColumn(index, F.col("_n") - F.col("_r")).where(F.col(index) >= size)
    return first.withColumn(index, F.col("_r").cast("long") - 1).drop("_r").unionByName(last.drop("_r", "_n"))
