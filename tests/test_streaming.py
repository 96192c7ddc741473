"""Streams in several batches against their batch twins."""

import os
import time

import pytest
from pyspark.sql import functions as F

from promptmill.functions.grading import grade
from promptmill.operators.rules import tier1_chunks
from promptmill.operators.usage import cost_report
from promptmill.plans import improvement
from promptmill.streaming.outputs import start_grading
from promptmill.streaming.pools import finish_improving, start_improving
from promptmill.streaming.rules import all_chunks, start_chunks
from promptmill.streaming.usage import current_cost, start_totals
from checks import fixtures as fx
from tests.test_plans import MODELS, PAIRS, SEEDS, items  # noqa: F401


def _arriving(spark, parts, folder):
    """A stream that gets one of the parts per batch, in their order."""
    files = []
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/part{i}")
        (name,) = [f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.link(f"{folder}/part{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (time.time() - 100 + i,) * 2)
        files.append(name)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_grading(spark, small, tmp_path):
    outputs = fx.outputs(spark, small)
    stream = _arriving(spark, [outputs.where(F.col("item_id") % 3 == i) for i in range(3)], str(tmp_path))
    start_grading(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    _same(spark.read.parquet(f"{tmp_path}/out"), grade(outputs))


@pytest.mark.parametrize("cuts", [(7, 8, 400), (100, 101, 102)])
def test_chunks(spark, tmp_path, cuts):
    rules = spark.createDataFrame(
        [(0 if i % 4 else 1 + i % 8, i, f"rule {i}") for i in range(120)], "run_id long, item_id long, rule_text string")
    edges = [-1, *cuts, 10**6]
    parts = [rules.where(f"item_id > {a} and item_id <= {b}") for a, b in zip(edges, edges[1:])]
    running = start_chunks(_arriving(spark, parts, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/log")
    running.awaitTermination()
    _same(all_chunks(spark, f"{tmp_path}/out", running.lastProgress["batchId"]), tier1_chunks(rules))


def test_totals(spark, small, tmp_path):
    usage, keys = fx.usage(spark, small), ["run_id", "role"]
    stream = _arriving(spark, [usage.where(F.col("call_id") % 3 == i) for i in range(3)], str(tmp_path))
    start_totals(stream, keys, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    _same(current_cost(spark, f"{tmp_path}/out", keys), cost_report(usage, keys))


@pytest.fixture(scope="module")
def few(spark, items):  # noqa: F811
    """Some items of two runs, and the tables of their iterative run."""
    some = items.where("run_id = 1 or run_id = 0 and item_id < 36")
    return some, improvement.run_iterative(some, SEEDS, MODELS, PAIRS)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_pools_change_at_the_same_items_in_any_batches(spark, few, tmp_path, batches):
    some, want = few
    parts = [some.where(F.floor(F.col("item_id") * batches / 36) == i) for i in range(batches)]
    base = f"{tmp_path}/out"
    running = start_improving(_arriving(spark, parts, str(tmp_path)), SEEDS, MODELS, PAIRS, base, f"{tmp_path}/log")
    running.awaitTermination()
    got = finish_improving(spark, base, running.lastProgress["batchId"], MODELS, PAIRS)
    for name in ("graded", "status", "tier1", "pools", "final_rule", "final_prompts"):
        _same(getattr(got, name), getattr(want, name))
    assert got.pools.select("run_id", "valid_from").distinct().count() > 4


def test_pools_change_between_batches(spark, items, tmp_path):  # noqa: F811
    from promptmill.operators.ordered import with_ordinal
    numbered = with_ordinal(items, ["run_id"], "item_id")
    parts = [numbered.where(F.floor(F.col("ordinal") / 14) == i).drop("ordinal") for i in range(2)]
    base = f"{tmp_path}/out"
    start_improving(_arriving(spark, parts, str(tmp_path)), SEEDS, MODELS, PAIRS, base, f"{tmp_path}/log", relaxed=True) \
        .awaitTermination()
    twin = improvement.run_iterative(items, SEEDS, MODELS, PAIRS, block=14, relaxed=True)
    got = improvement.finish_rounds(spark, base, 2, MODELS, PAIRS)
    for name in ("status", "tier1", "pools", "final_rule", "final_prompts"):
        _same(getattr(got, name), getattr(twin, name))
    assert got.pools.select("valid_from").distinct().count() > 1
    # Every item counts once, and pools only change where a block ends.
    assert got.status.count() == items.count()
    starts = {r.valid_from for r in got.pools.where("run_id = 0").select("valid_from").distinct().collect()}
    assert starts <= {0, 3 * 13 + 1, 3 * 25 + 1}
