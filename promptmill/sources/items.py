"""Reading question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from promptmill import schemas
from promptmill.operators import items as ops


def _read(spark: SparkSession, paths: str | list[str], fmt: str, schema: T.StructType) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(paths)


def read_choice_items(spark: SparkSession, paths: str | list[str], fmt: str = "parquet",
                      subsets: str | list[str] | None = "all", limit: int | None = None,
                      offset: int = 0) -> DataFrame:
    """Items of the requested subsets, sliced per subset, in one scan.

    Rows whose answer index has no letter keep a null answer; see ``answerable``.
    """
    raw = ops.filter_subsets(_read(spark, paths, fmt, schemas.RAW_CHOICE_ITEM), subsets)
    return ops.choice_items(ops.slice_subsets(raw, limit, offset))


def read_held_out_items(spark: SparkSession, paths: str | list[str], fmt: str = "parquet",
                        subjects: str | list[str] | None = "all", limit: int | None = None) -> DataFrame:
    raw = ops.filter_subsets(_read(spark, paths, fmt, schemas.RAW_CHOICE_ITEM), subjects)
    return ops.held_out_items(ops.slice_subsets(raw, limit))


def read_math_items(spark: SparkSession, paths: str | list[str], fmt: str = "parquet",
                    limit: int | None = None, offset: int = 0) -> DataFrame:
    items = ops.math_items(_read(spark, paths, fmt, schemas.RAW_MATH_ITEM))
    return ops.slice_subsets(items, limit, offset, subset="source")
