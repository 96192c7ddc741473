"""Ordered work within groups of any size.

A window over a whole run or subset puts that group into one task, and one run may
hold a third of all rows. The operators here deal rows into ranges of equal size instead, by sampled split
points in the order of keys and then of the rows, so it makes no difference whether positions are dense, hashed or
one time stamp for most rows. A group lies in as many neighbouring ranges as it fills; what earlier
ranges hold of it is carried in from a table with one row a group and range. Rows and their ranges are
written before anything is carried, so that a recomputed task meets the same ranges.

A table of at most ``width`` rows is one range and is not written. Rows are read several times: store the result
of a costly or changing step before it is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from promptmill.workspace import written

#: Rows of a range; there are no more ranges than the session has shuffle partitions.
BUCKET = 100_000


def ranges_of(df: DataFrame, width: int = BUCKET) -> int:
    """How many ranges the rows of ``df`` are dealt into."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-df.count() // width)))


def ranged(df: DataFrame, order: list[str], ranges: int, index: str | None = None) -> DataFrame:
    """Written rows with ``_bucket``, the number of their range, which never falls in ``order``.

    ``index``, if given, numbers the rows of a range in ``order``.
    """
    rows = df.repartitionByRange(ranges, *order)
    if index is not None:
        # Sorted, so that the number of a row within its task is its place in the range.
        rows = rows.sortWithinPartitions(*order).withColumn(index, F.monotonically_increasing_id() % F.lit(1 << 33))
    return written(rows.withColumn("_bucket", F.spark_partition_id().cast("long")), "ranges")


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its ``keys`` as columns without nulls, so that null is a key like any other in joins."""
    names = []
    for k in keys:
        names += [f"_none_{k}", f"_key_{k}"]
        kind = df.schema[k].dataType
        value = F.coalesce(F.col(k), F.lit(0).cast(kind)) if isinstance(kind, NumericType) else F.coalesce(
            F.col(k).cast("string"), F.lit(""))
        df = df.withColumn(f"_none_{k}", F.col(k).isNull()).withColumn(f"_key_{k}", value)
    return df, names


def ordinal_over_buckets(df: DataFrame, keys: list[str], bucket: str, order: list[str],
                         out: str = "ordinal") -> DataFrame:
    """Add the 0-based ordinal of every row within ``keys``, buckets first and ``order`` within them.

    Joining the carried counts and numbering the rows need the same partitioning, so the
    rows are shuffled once.
    """
    df, safe = keyed(df, keys)
    split = [*safe, bucket]
    earlier = Window.partitionBy(*safe).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*split).count().select(
        *split, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*split).orderBy(*order)
    return (
        df.join(carried, split)
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before", *safe)
    )


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def with_ordinal(df: DataFrame, keys: list[str], position: str, out: str = "ordinal",
                 width: int = BUCKET) -> DataFrame:
    """Add the 0-based ordinal of every row within ``keys``, by ascending ``position``.

    Positions must be distinct within a group. Null keys are a group; null positions come first. Rows are
    shuffled once: a row's place in its range and the place where its group begins there say the rest.
    """
    rows, safe = keyed(df, keys)
    ranges = ranges_of(df, width)
    if ranges == 1:
        inside = Window.partitionBy(*safe).orderBy(position)
        return rows.withColumn(out, F.row_number().over(inside).cast("long") - 1).drop(*safe)
    placed = ranged(rows, [*safe, position], ranges, "_place")
    split = [*safe, "_bucket"]
    parts = placed.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_place").alias("_begin"))
    carried = parts.select(*split, (F.coalesce(F.sum("_n").over(_earlier(safe)), F.lit(0)) - F.col("_begin")).alias("_before"))
    return placed.join(carried, split).withColumn(out, F.col("_before") + F.col("_place")).drop("_before", "_place", "_bucket", *safe)


def with_running_sums(df: DataFrame, keys: list[str], position: Column, order: list[str],
                      sums: dict[str, str], width: int = BUCKET) -> DataFrame:
    """Add running totals within ``keys``: ``sums`` maps a new column to the one it adds up.

    ``position`` never falls in the order of ``order``.
    """
    rows, safe = keyed(df.withColumn("_position", position), keys)
    ranges = ranges_of(df, width)
    split = [*safe, "_bucket"] if ranges > 1 else safe
    before = {o: F.col(f"_before_{o}") if ranges > 1 else F.lit(0) for o in sums}
    if ranges > 1:
        rows = ranged(rows, [*safe, "_position", *order], ranges)
        totals = rows.groupBy(*split).agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
        rows = rows.join(totals.select(*split, *[
            F.coalesce(F.sum(f"_sum_{o}").over(_earlier(safe)), F.lit(0)).alias(f"_before_{o}") for o in sums]), split)
    inside = Window.partitionBy(*split).orderBy("_position", *order).rowsBetween(Window.unboundedPreceding, 0)
    for name, column in sums.items():
        rows = rows.withColumn(name, before[name] + F.sum(column).over(inside))
    return rows.drop("_bucket", "_position", *safe, *[f"_before_{o}" for o in sums])


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], position: str, mark: str,
          width: int = BUCKET) -> DataFrame:
    """Add to every row the largest ``mark`` of its group that is not above its ``position``.

    Rows before the first mark, and rows without a position, get null; null marks are none. Rows and marks meet in one
    order, not in a join of every mark with every row; the mark in force when a range begins comes from the carried table.
    """
    left = rows.withColumn("_at", F.col(position)).withColumn(mark, F.lit(None).cast("long")).withColumn("_is_row", F.lit(True))
    set_ = marks.where(F.col(mark).isNotNull()).select(*keys, F.col(mark).cast("long").alias(mark)).distinct()
    right = set_.withColumn("_at", F.col(mark)).withColumn("_is_row", F.lit(False))
    left, safe = keyed(left, keys)
    right, _ = keyed(right, keys)
    # A mark comes before the rows of its own position.
    both = left.unionByName(right, allowMissingColumns=True)
    ranges = ranges_of(both, width)
    split = [*safe, "_bucket"] if ranges > 1 else safe
    carried = F.lit(None).cast("long")
    if ranges > 1:
        both = ranged(both, [*safe, "_at", "_is_row"], ranges)
        newest = both.groupBy(*split).agg(F.max(mark).alias("_newest"))
        both = both.join(newest.select(*split, F.max("_newest").over(_earlier(safe)).alias("_carried")), split)
        carried = F.col("_carried")
    inside = Window.partitionBy(*split).orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn(mark, F.coalesce(F.max(mark).over(inside), carried))
            .where("_is_row").drop("_bucket", "_at", "_is_row", "_carried", *safe))


def with_dense_rank(df: DataFrame, by: str, out: str = "rank") -> DataFrame:
    """Dense rank of all rows by descending ``by``.

    Only the distinct values are put into one order. There are at most about the square
    root of twice the summed values of them where ``by`` is a count, however many rows.
    """
    ranks = df.select(by).distinct().withColumn(
        out, F.dense_rank().over(Window.orderBy(F.col(by).desc())))
    return lookup(df, ranks, [by])


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a ``table`` that has at most one row per key; a null key meets a null key.

    No broadcast is forced: the optimizer broadcasts the table when its size is below the
    threshold. Beyond that both sides are shuffled, and adaptive skew handling splits a key that
    many rows share.
    """
    left, safe = keyed(rows, keys)
    right, _ = keyed(table, keys)
    return left.join(right.drop(*keys), safe, how).select(*rows.columns, *[c for c in table.columns if c not in keys])
