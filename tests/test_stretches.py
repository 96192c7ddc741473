"""Stretches of exact iterative runs: played in a task item by item, they are what rounds make of them."""

import pickle
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptmill.functions import plain
from promptmill.functions import text as tx
from promptmill.functions.grading import graded_all
from promptmill.plans import improvement, rounds, stretches
from promptmill.plans.steps import Models
from promptmill.workspace import folders, fresh_folder
from tests.test_plans import MODELS, PAIRS, SEEDS, items  # noqa: F401

TABLES = ("graded", "candidates", "status", "rules", "tier1", "pools")
ODD = ["", "  A ", "b", "The answer is (c). Not (E)", "so \\boxed{ d } it is (a)", "answer: nothing here", "Answer is A answer is", "1,234.5 or 12", "-3.",
       "no number", "I think (b) or e", "option: (z) choice: d", "E" * 12, " yes ", "x\nThe ANSWER IS\n(B)\n", "12", "\U0001d49ca is all of this text", "not éa but d é",
       "x (a)\x85 12 -", "İs the answer is: (B)", "it's", "say \"it's\"\\\t\r\n", "7" * 400, "\\BOXED{E}", "e" + "\U0001d49c" * 3 + " is a word here", "²) numbered line with ) and .",
       "here are ten or more", "\"'quoted line of text'\"", "1. Think about it)", "٣ numbered. in other digits",
       "<REWRITE_BEGIN> a </REWRITE_END><rewrite_begin>\n</rewrite_end>", "<REWRITE BEGIN>b</REWRITE_END>", "<REWRITE_BEGIN>no end"]


def _tables(spark, some, settings, models=MODELS, block=None):
    base = fresh_folder(spark, "stretches")
    n = improvement.play_items(some, SEEDS, models, settings, base, 0, block)
    done = improvement.tables_of(spark, base, n)
    return n, len(folders(spark, f"{base}/played")), {name: sorted(map(str, done[name].collect())) for name in TABLES}


def _always_ruled():
    def scorer(system, user):
        return "(A)" if "Better" in system + user else "(B)"

    def optimizer(system, user):
        return "<REWRITE_BEGIN>Better one</REWRITE_END>" if user.startswith("[TASK CONTEXT]") else "Think about all things"
    return Models(lambda: scorer, lambda: optimizer)


def _never_wrong():
    return Models(lambda: lambda system, user: "(A)", lambda: lambda system, user: "")


def _many(spark, n):
    return spark.range(n).selectExpr("0L as run_id", "id as item_id", "'q' as question", "'A' as answer", "'multiple_choice' as type", "'s' as subset")


def test_jobs_do_not_follow_the_number_of_chunks(spark):
    """A job a chunk took a second or two, and a long run has thousands of chunks."""
    base, sc = fresh_folder(spark, "few-jobs"), spark.sparkContext
    sc.setJobGroup("stretch", "chunks")
    try:
        n = improvement.play_items(_many(spark, 240), SEEDS, _always_ruled(), PAIRS, base, 0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    done = improvement.tables_of(spark, base, n)
    assert done["tier1"].count() == 120 and done["status"].count() == 240 and n == 120
    assert len(sc.statusTracker().getJobIdsForGroup("stretch")) < 30


def test_a_stretch_asks_nothing_twice(spark, tmp_path):
    def scorer():
        def answer(system, user):
            with open(f"{tmp_path}/asked", "a", encoding="utf-8") as file:
                file.write(f"{user!r}\n")
            return "(A)" if "Better" in user else "(B)"
        return answer
    some = _many(spark, 30).withColumn("question", F.concat(F.lit("q"), "item_id"))
    _tables(spark, some, PAIRS, replace(_always_ruled(), scorer=scorer))
    asked = open(f"{tmp_path}/asked", encoding="utf-8").read().splitlines()
    # Two items under three seeds, then one prompt each; a rewrite tried for each wrong prompt that has one.
    assert len(asked) == 2 * 3 + 28 + 30 and len(set(asked)) == len(asked)


def test_a_stretch_is_what_rounds_are(spark, items):  # noqa: F811
    """Null keys and texts, rows that stand twice and columns of any kind too."""
    odd = spark.createDataFrame(
        [(None, i, q, a, k, None) for i, (q, a, k) in enumerate([("q", "A", None), (None, "B", "multiple_choice"), ("x", None, "math"), ("y", None, "multiple_choice"), ("z", "12", "math")] * 3)],
        items.schema)
    twice = items.where("run_id = 1")
    some = items.where("item_id < 40").unionByName(twice).unionByName(odd).withColumns({
        "at": F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, item_id)"), "of it": F.expr("struct(array(subset) as l, map(run_id is null, item_id) as m)")})
    n, jobs, one = _tables(spark, some, PAIRS)
    # More calls in flight than there are runs are asked for: rounds.
    m, as_rounds, other = _tables(spark, some, replace(PAIRS, partitions=7))
    assert as_rounds == m and jobs < n
    for name in TABLES:
        assert one[name] == other[name], name
    assert len(one["tier1"]) > 3 and any("run_id=None" in row for row in one["status"])


def test_a_wide_run_is_dealt_to_tasks(spark):
    """Where no chunk fills, a run's items are independent and are not left to one task."""
    n, jobs, one = _tables(spark, _many(spark, 1_600), PAIRS, _never_wrong(), block=200)
    # Blocks of 200 and 400 are a stretch, those of 800 and 200 rounds.
    assert (n, jobs) == (4, 3)
    assert one == _tables(spark, _many(spark, 1_600), replace(PAIRS, partitions=2), _never_wrong(), block=200)[2]
    assert len(one["status"]) == 1_600


def test_runs_go_on_after_a_stretch_of_the_most_items(spark, monkeypatch):
    some = _many(spark, 60).unionByName(_many(spark, 13).withColumn("run_id", F.lit(1).cast("long")))
    _, _, whole = _tables(spark, some, PAIRS, _always_ruled())
    monkeypatch.setattr(rounds, "MOST", 7)
    _, jobs, parts = _tables(spark, some, PAIRS, _always_ruled())
    assert jobs == 9 and parts == whole
    # More runs than are numbered are dealt by hash.
    monkeypatch.setattr(rounds, "NUMBERED_RUNS", 1)
    assert _tables(spark, some, PAIRS, _always_ruled())[2] == whole


def test_a_part_played_again_leaves_nothing_of_the_first_time(spark, items):  # noqa: F811
    """Jobs of rounds and of stretches are cut at other rounds."""
    base = fresh_folder(spark, "again")
    for settings in (replace(PAIRS, partitions=7), PAIRS):
        n = improvement.play_items(items, SEEDS, MODELS, settings, base, 0)
    done = improvement.tables_of(spark, base, n)
    assert done["status"].count() == items.count() and len(folders(spark, f"{base}/played")) < n


@pytest.mark.parametrize("kind, answer", [("multiple_choice", "b"), ("multiple_choice", " e"), ("math", "so 12"), ("math", "7" * 400), ("math", None), ("general", " yes"),
                                          (None, "12"), ("multiple_choice", None)])
def test_plain_outcomes_are_those_of_columns(spark, kind, answer):
    one = spark.createDataFrame([([*ODD, None], answer, kind)], "outputs array<string>, answer string, type string")
    assert [plain.outcome_of(text, answer, kind) for text in [*ODD, None]] == one.select(graded_all(F.col("outputs"), F.col("answer"), F.col("type"))).first()[0]


def test_plain_texts_are_those_of_columns(spark):
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(ODD + ["\n".join(ODD), "x" * 301])], "i int, text string")
    got = tx.with_tag_blocks(rows, "text", "REWRITE", "rewrites").select(
        "text", "rewrites", tx.python_repr(F.col("text")).alias("shown"), tx.snippet(F.col("text")).alias("cut"), tx.generated_prompts(F.col("text"), 4).alias("prompts"),
        tx.last_number(F.col("text")).alias("number"), F.get(tx.strict_choices(F.array("text")), F.lit(0)).alias("letter")).collect()
    for r in got:
        assert (r.rewrites, r.shown, r.cut, r.prompts, r.number, r.letter) == (
            plain.rewrites_in(r.text), plain.python_repr(r.text), plain.snippet(r.text), plain.generated_prompts(r.text, 4), plain.last_number(r.text), plain.strict_choice(r.text))
    assert plain.rewrites_in(None) == plain.generated_prompts(None, 4) == []


def test_executors_need_not_import_the_library(spark, items, tmp_path):  # noqa: F811
    play, _ = stretches.player(_always_ruled(), PAIRS, 8, 100, 100, items.schema)
    code = cloudpickle.dumps(play)
    pickle.loads(code)
    with open(f"{tmp_path}/play", "wb") as file:
        file.write(code)
    told = subprocess.run([sys.executable, "-I", "-c", f"import pickle, sys; pickle.load(open({f'{tmp_path}/play'!r}, 'rb')); print([m for m in sys.modules if 'promptmill' in m])"],
                          cwd=tmp_path, capture_output=True, text=True)
    assert told.stdout == "[]\n", told.stderr[-500:]


def test_pools_in_force_over_many_chunks(spark, items):  # noqa: F811
    """One table of one job holds many pools, each in force from the item after its chunk."""
    from promptmill.operators.pools import ask_pool_in_force
    base = fresh_folder(spark, "in-force")
    n = improvement.play_items(items, SEEDS, MODELS, PAIRS, base, 0)
    done, keys = improvement.tables_of(spark, base, n), ["run_id", "item_id", "prompt_pos", "prompt"]
    due = ask_pool_in_force(items.select("run_id", "item_id"), done["pools"])
    assert sorted(map(tuple, done["graded"].select(keys).collect())) == sorted(map(tuple, due.select(keys).collect()))
    made = done["tier1"].selectExpr("run_id", "sample_idx + 1 as valid_from")
    assert done["pools"].where("valid_from > 0").join(made, ["run_id", "valid_from"], "left_anti").isEmpty()
    assert done["pools"].select("run_id", "valid_from").distinct().count() > 4 and len(folders(spark, f"{base}/played")) < n


def test_a_batch_of_a_stream_does_not_take_a_job_a_chunk(spark, tmp_path):
    from promptmill.streaming.pools import last_round, start_improving
    base, some = f"{tmp_path}/out", _many(spark, 80)
    for part in ("item_id < 40", "item_id >= 40"):
        some.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = start_improving(arriving, SEEDS, _always_ruled(), PAIRS, base, f"{tmp_path}/log")
    running.awaitTermination()
    n = last_round(spark, base, running.lastProgress["batchId"])
    assert improvement.tables_of(spark, base, n)["tier1"].count() == n == 40
    assert len(folders(spark, f"{base}/played")) <= 4
