"""Stored run folders, matching of names, publication of whole runs and totals that stay small."""

import os

import pytest
from pyspark.sql import functions as F

from promptmill.functions.names import run_parts
from promptmill.operators import reports as rp
from promptmill.operators.usage import cost_report
from promptmill.plans import improvement, publish
from promptmill.plans.files import TABLES
from promptmill.sources import runs as st
from promptmill.streaming.usage import current_cost, start_totals
from promptmill.workspace import folders
from tests.test_plans import MODELS, PAIRS, SEEDS, items  # noqa: F401
from tests.test_streaming import _arriving, _same

A, B, C = ("small-7b_large-32b_MMLU_All_Lim100_Base_0_20251213-160014", "small-7b_large-32b_MMLU_2Sub_Lim-1_Iter_5_20251213-160114",
           "old-7b_large-32b_Limit50_IterOn_5_20251101-090000")


def test_run_folders(spark, tmp_path):
    for name, prompts in ((A, "first é\n\nsecond\n"), (B, "\n \n"), ("deep/down/" + C, None)):
        os.makedirs(tmp_path / "runs" / name)
        (tmp_path / "runs" / name / "optimization_status.csv").write_text("id\n")
        if prompts is not None:
            (tmp_path / "runs" / name / "optimized_prompts.txt").write_text(prompts)
    os.makedirs(tmp_path / "runs" / "notes")
    (tmp_path / "runs" / "notes" / "optimized_prompts.txt").write_text("no run\n")
    got = {r.run_name: r for r in st.stored_runs(spark, f"{tmp_path}/runs").collect()}
    assert {k: (r.n_files, r.n_prompts) for k, r in got.items()} == {A: (2, 2), B: (2, 0), C: (1, None)}
    assert (got[B].mode, got[B].limit, got[B].subset_label, got[C].mode, got[C].dataset) == ("Iter", -1, "2Sub", "Iter", None)
    assert {tuple(r) for r in st.stored_prompts(spark, f"{tmp_path}/runs").collect()} == {(A, 0, "first é"), (A, 1, "second")}
    (tmp_path / "eval").mkdir()
    line = "-" * 30 + "\n"
    (tmp_path / "eval" / f"{A}_validation_eval.txt").write_text(
        f"Evaluation Report\nModel: m\n\nPrompt #1 Accuracy: 50.00% (1/2)\nPrompt: first é...\n{line}")
    (tmp_path / "eval" / f"{A}_test_eval.txt").write_text(f"Prompt #1 Accuracy: 25.00% (1/4)\nPrompt: first é...\n{line}")
    (tmp_path / "eval" / "summary.txt").write_text("Prompt #9 Accuracy: 25.00% (1/4)\n")
    told = {tuple(r) for r in st.evaluated_prompts(spark, f"{tmp_path}/runs", f"{tmp_path}/eval").collect()}
    assert told == {(A, 1, "first é", "validation", 1, 2), (A, 1, "first é", "test", 1, 4), (A, 2, "second", None, None, None)}


def test_listing_opens_no_file(spark, tmp_path):
    os.makedirs(tmp_path / A)
    (tmp_path / A / "x.json").write_text("{}")
    plan = st.stored_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.partition("ReadSchema")[2]


def test_runs_nearest_in_time(spark):
    def named(names):
        return spark.createDataFrame([(n,) for n in names], "path string").select(F.col("path"), *run_parts(F.col("path")))
    stored = named([
        "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160014", "s-7_l-32_MMLU_All_Lim100_Iter_5_20251213-160014",  # one second
        "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160020", "s-7_l-32_MATH_NA_Lim100_Base_0_20251213-160019",
        "t-7_l-32_MMLU_All_Lim100_Base_0_20251213-235959"]).withColumnRenamed("path", "run_path")
    asked = {
        "s-7_l-32_Limit100_IterOff_20251213-160014": "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160014",  # an older name
        "s-7_l-32_Limit100_IterOn_5_20251213-160016": "s-7_l-32_MMLU_All_Lim100_Iter_5_20251213-160014",
        "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160017": "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160014",  # a tie
        "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160019": "s-7_l-32_MMLU_All_Lim100_Base_0_20251213-160020",
        "t-7_l-32_MMLU_All_Lim100_Base_0_20251214-000003": "t-7_l-32_MMLU_All_Lim100_Base_0_20251213-235959",
        "t-7_l-32_MMLU_All_Lim100_Base_0_20251214-000005": None, "s-7_l-32_Limit7_IterOff_20251213-160014": None, "no name": None}
    got = rp.with_nearest_run(named(asked), stored, "path")
    assert {r.path: r.run_path for r in got.collect()} == {k: v for k, v in asked.items() if v}
    assert {r.seconds_away for r in got.collect()} == {0, 1, 2, 3, 4}


@pytest.fixture(scope="module")
def done(items):  # noqa: F811
    return improvement.run_base(items, SEEDS, MODELS, PAIRS)


def test_published_runs(spark, items, done, tmp_path, monkeypatch):  # noqa: F811
    folder = f"{tmp_path}/runs"
    assert publish.published(spark, folder, "optimization_status") is None and publish.manifest(spark, folder).isEmpty()
    first = publish.publish_run(done, items, folder)
    want = sorted(map(tuple, done.status.select("run_id", "item_id", "status").collect()))

    def shown(table="optimization_status"):
        return sorted(map(tuple, publish.published(spark, folder, table).select("run_id", "id", "status").collect()))
    assert shown() == want
    # A writer that dies between its folders, and one that dies before it publishes, leave the old runs whole.
    from promptmill.sources import results
    with monkeypatch.context() as killed:
        killed.setattr(results, "write_prompts", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            publish.publish_run(done, items, folder)
    unpublished = publish.stage_run(done, items, folder)
    assert shown() == want
    prompts = publish.published(spark, folder, "optimized_prompts")
    assert sorted(map(tuple, prompts.select("run_id", "prompt_pos", "prompt").collect())) == sorted(
        map(tuple, done.final_prompts.select("run_id", "prompt_pos", "prompt").collect()))
    # One run is replaced, the others stay.
    second = publish.publish_run(done, items.where("run_id = 1"), folder)
    live = {r.run_id: r.version for r in publish.manifest(spark, folder).collect()}
    assert live == {0: first, 1: second, 2: first} and shown() == want
    assert publish.vacuum(spark, folder) == 2 and shown() == want
    for table in TABLES[:-1]:
        assert f"version={unpublished}" not in folders(spark, f"{folder}/tables/{table}")
    assert publish.published(spark, folder, "cost_report") is None


def test_writers_that_meet(spark, items, tmp_path, monkeypatch):  # noqa: F811
    """Another writer takes the next manifest's number while this one is at work: both publications stand."""
    folder, met, real = f"{tmp_path}/runs", [], publish.claimed

    def claimed(session, staged, path):
        if not met:
            met.append(1)
            publish.publish(items.where("run_id = 2"), folder, "v-other")
        return real(session, staged, path)
    monkeypatch.setattr(publish, "claimed", claimed)
    assert publish.publish(items.where("run_id < 2"), folder, "v-own") == 1
    assert {r.run_id: r.version for r in publish.manifest(spark, folder).collect()} == {0: "v-own", 1: "v-own", 2: "v-other"}


def test_totals_stay_few_folders(spark, tmp_path):
    usage = spark.range(400).selectExpr("id as call_id", "id % 3 as run_id", "if(id % 7 < 4, 'scorer', 'optimizer') as role",
                                        "id as prompt_tokens", "id % 5 as completion_tokens")
    parts = [usage.where(F.col("call_id") % 11 == i) for i in range(11)]
    keys, out = ["run_id", "role"], f"{tmp_path}/out"
    start_totals(_arriving(spark, parts, str(tmp_path)), keys, out, f"{tmp_path}/log", fold_batches=2).awaitTermination()
    _same(current_cost(spark, out, keys), cost_report(usage, keys))
    assert set(folders(spark, out)) == {"totals-7", "totals-9", "changes-8", "changes-9", "changes-10"}
    # A fold that is played again gives the same table.
    from promptmill.streaming import usage as us
    us._fold(spark, keys, out, 9)
    _same(current_cost(spark, out, keys), cost_report(usage, keys))


def test_a_version_holds_its_own_runs_only(spark, items, done, tmp_path):  # noqa: F811
    folder = f"{tmp_path}/runs"
    version = publish.stage_run(done, items.where("run_id = 1"), folder)
    for table in ("optimization_status", "detailed_results", "prompt_history"):
        path = f"{folder}/tables/{table}/version={version}"
        read = spark.read.option("header", True).csv(path) if table == "optimization_status" else spark.read.json(path)
        assert {r.run_id for r in read.select("run_id").collect()} == {1}
