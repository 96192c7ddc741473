"""Jobs that are killed and started again: answers are asked once, and usage is counted once."""

import os
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks.models import SETTINGS
from promptmill.operators.requests import SEED_PROMPTS
from promptmill.plans import improvement
from promptmill.plans.steps import Models
from promptmill.sources.results import read_usage
from tests.answers import optimizer, scorer

# Models reach executors as code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = replace(SETTINGS, group_size=2, max_tries=1, piece_calls=12, scorer_name="small", optimizer_name="large")
ITEMS = "run_id long, item_id long, question string, answer string, type string, subset string"


def counted(build, folder, kill_at=None):
    """A model that notes every call, and takes its process down at the ``kill_at``-th while the folder is armed."""
    def made():
        call = build()

        def answer(system, user):
            with open(f"{folder}/{os.getpid()}", "a", encoding="utf-8") as file:
                file.write("x")
            if kill_at and os.path.exists(f"{folder}-armed") and calls(folder) >= kill_at:
                raise SystemExit("killed")
            said = call(system, user)
            return said, len(user), len(said)
        return answer
    return made


def calls(folder):
    return sum(os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder))


def models(folder, kill_at=None):
    os.makedirs(folder, exist_ok=True)
    return Models(counted(scorer, folder, kill_at), counted(optimizer, folder, kill_at))


@pytest.fixture(scope="module")
def items(spark):
    from promptmill.workspace import written
    rows = [(run, 2 * i, "q" * (i * 7 % 23), "AB"[i % 2], "multiple_choice", "s") for run, n in ((0, 9), (1, 3)) for i in range(n)]
    return written(spark.createDataFrame(rows, ITEMS), "items")


def tables(run):
    return {name: sorted(map(str, getattr(run, name).select(*columns).collect())) for name, columns in {
        "graded": ("run_id", "item_id", "prompt_pos", "raw_output", "outcome"), "status": ("run_id", "item_id", "status"),
        "final_rule": ("run_id", "rule_text"), "final_prompts": ("run_id", "prompt_pos", "prompt"), "pools": ("run_id", "valid_from", "prompt")}.items()}


def used(spark, folder):
    rows = read_usage(spark, folder)
    assert rows.count() == rows.select("call_id", "step", "round", "level").distinct().count()
    assert rows.where("ts is null or model is null or run_id is null").isEmpty()
    return sorted(map(tuple, rows.groupBy("run_id", "role", "model", "step", "round", "level").agg(
        F.count("*"), F.sum("prompt_tokens"), F.sum("completion_tokens")).collect()))


JOBS = {
    "base": lambda items, m, s: improvement.run_base(items, SEED_PROMPTS[:2], m, s),
    "left_deep": lambda items, m, s: improvement.run_base(items, SEED_PROMPTS[:2], m, replace(s, merge_order="left_deep")),
    "iterative": lambda items, m, s: improvement.run_iterative(items.where("run_id = 1 or item_id < 8"), SEED_PROMPTS[:2], m, s, block=4),
}


@pytest.mark.parametrize("job, share", [("base", 0.3), ("left_deep", 0.9), ("iterative", 0.6)])
def test_a_killed_job_asks_what_has_no_answer(spark, items, tmp_path, job, share):
    plain = JOBS[job](items, models(f"{tmp_path}/plain"), replace(PAIRS, usage_folder=f"{tmp_path}/plain-usage"))
    want, need = tables(plain), calls(f"{tmp_path}/plain")
    kill_at = int(need * share)
    folder, settings = f"{tmp_path}/calls", replace(PAIRS, answers=f"{tmp_path}/store", usage_folder=f"{tmp_path}/usage")
    open(f"{folder}-armed", "w").close()
    with pytest.raises(Exception):
        JOBS[job](items, models(folder, kill_at), settings)
    os.remove(f"{folder}-armed")
    assert kill_at <= calls(folder) < need
    assert tables(JOBS[job](items, models(folder, kill_at), settings)) == want
    # Only the piece in hand is asked again (pieces are cut by hash, so some hold a few more).
    assert need <= calls(folder) <= need + 2 * PAIRS.piece_calls
    before = calls(folder)
    assert tables(JOBS[job](items, models(folder), settings)) == want and calls(folder) == before
    assert used(spark, f"{tmp_path}/usage") == used(spark, f"{tmp_path}/plain-usage")


def test_usage_of_a_job_played_twice(spark, items, tmp_path):
    settings = replace(PAIRS, usage_folder=f"{tmp_path}/usage")
    once = None
    for _ in range(2):
        JOBS["base"](items, models(f"{tmp_path}/calls"), settings)
        once = once or used(spark, f"{tmp_path}/usage")
    assert used(spark, f"{tmp_path}/usage") == once and {r[1] for r in once} == {"scorer", "optimizer"}


def test_requests_that_stand_twice_or_have_null_keys(spark, tmp_path):
    from promptmill.operators.completion import complete_once
    rows = [(1, "s", "u"), (1, "s", "u"), (2, "s", "u"), (None, "s", "u"), (None, "s", "v"), (3, None, "w")]
    asked = spark.createDataFrame(rows, "id long, system string, user string")

    def model():
        return lambda system, user: f"{system} {user}"
    for _ in range(2):
        got = complete_once(asked, model, f"{tmp_path}/store", ["id"], piece_calls=2)
        assert sorted(map(str, got.select("id", "raw_output").collect())) == sorted(
            f"Row(id={i}, raw_output='{s} {u}')" for i, s, u in rows)
        assert spark.read.parquet(f"{tmp_path}/store").count() == 5
    assert complete_once(asked.limit(0), model, f"{tmp_path}/none", ["id"]).count() == 0


def test_jobs_do_not_follow_the_number_of_pieces(spark, tmp_path):
    from promptmill.operators.completion import complete_once
    asked = spark.range(240).selectExpr("id", "'s' as system", "concat('u', id) as user")
    for partitions, most in ((None, 20), (30, 30)):
        spark.sparkContext.setJobGroup(f"pieces-{partitions}", "")
        got = complete_once(asked, scorer, f"{tmp_path}/store-{partitions}", ["id"], piece_calls=4, partitions=partitions, retry_delay=0.0)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got.select("id", "raw_output").distinct().count() == 240
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pieces-{partitions}")) < most


def test_answers_of_finished_tasks_stay_when_the_job_is_lost(spark, tmp_path):
    from promptmill.operators.completion import complete_once
    asked = spark.range(240).selectExpr("id", "'s' as system", "concat('u', id) as user")
    folder, store = f"{tmp_path}/calls", f"{tmp_path}/store"
    os.makedirs(folder)
    open(f"{folder}-armed", "w").close()
    with pytest.raises(Exception):
        complete_once(asked, counted(scorer, folder, 150), store, ["id"], piece_calls=4, max_tries=1)
    os.remove(f"{folder}-armed")
    kept, lost = spark.read.parquet(store).count(), calls(folder)
    # A task has some 4 calls, and every core has one in hand.
    assert lost - kept <= 12 * spark.sparkContext.defaultParallelism and kept > 0
    complete_once(asked, counted(scorer, folder), store, ["id"], piece_calls=4, max_tries=1)
    assert calls(folder) == lost + 240 - kept and spark.read.parquet(store).select("request_id").distinct().count() == 240


def test_texts_of_a_job_started_again_take_little_disk(spark, tmp_path):
    """Texts were sorted by request id to find those without an answer, so that the requests of one item no longer lay beside each other."""
    from promptmill.operators.completion import complete_once
    from promptmill.workspace import shared_folder
    shared, sizes = shared_folder(spark).removeprefix("file:"), f"{tmp_path}/sizes"
    there = set(os.listdir(shared))

    def size():
        return sum(os.path.getsize(f"{at}/{name}") for top in set(os.listdir(shared)) - there for at, _, names in os.walk(f"{shared}/{top}") for name in names)

    def measured():
        def answer(system, user):
            with open(sizes, "a", encoding="utf-8") as file:
                file.write(f"{size()}\n")
            return user[:20]
        return answer
    asked = spark.range(60).selectExpr("id", "array_join(transform(sequence(1, 125), x -> sha2(concat(id, ' ', x), 256)), '') as question") \
        .selectExpr("id", "explode(array(0, 1, 2, 3, 4)) as pos", "question").coalesce(2).selectExpr("id", "pos", "'s' as system", "concat(pos, ' ', question) as user")
    keys = ["id", "pos"]
    complete_once(asked.where("id % 2 = 0"), scorer, f"{tmp_path}/store", keys, piece_calls=20, retry_delay=0.0)
    got = complete_once(asked, measured, f"{tmp_path}/store", keys, piece_calls=20)
    assert got.select("id", "pos").distinct().count() == got.count() == 300
    told = [int(line) for line in open(sizes, encoding="utf-8")]
    # 150 calls over 300 requests of 8,000 characters, five of each text.
    assert len(told) == 150 and max(told) < 300 * 8_000 / 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_jobs_of_a_piece_read_their_part(spark, tmp_path):
    """Requests of many jobs are cut by place; none is left out or asked twice."""
    from promptmill.operators.completion import complete_once
    asked = spark.range(0, 300, 1, 7).selectExpr("id % 150 as id", "'s' as system", "concat('u', id % 150) as user")
    for share, calls_so_far in (("id % 3 = 0", 50), ("true", 150)):
        folder = f"{tmp_path}/calls"
        os.makedirs(folder, exist_ok=True)
        complete_once(asked.where(share), counted(scorer, folder), f"{tmp_path}/store", ["id"], piece_calls=5, max_tries=1, partitions=4)
        assert calls(folder) == calls_so_far == spark.read.parquet(f"{tmp_path}/store").count()
