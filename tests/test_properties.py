"""What must hold for any outputs: nothing is lost, nothing is counted twice."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptmill.functions.grading import grade
from promptmill.operators import outcomes as oc
from promptmill.operators import refine as rf
from promptmill.operators.requests import ask_all, ask_pools

_QUIET = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
_TEXTS = st.one_of(st.none(), st.sampled_from(["(A)", "answer is b", "\\boxed{C}", "12", "no", ""]), st.text(max_size=12))
_OUTPUT = "run_id long, item_id long, prompt_pos int, prompt string, type string, answer string, raw_output string"


def _outputs(spark, texts):
    kinds = ("math", "multiple_choice", "general")
    rows = [(i % 2, i // 3, i % 3, f"p{i % 3 % 2}", kinds[i // 3 % 3], "A", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, _OUTPUT)


@settings(**_QUIET)
@given(st.lists(_TEXTS, max_size=40))
def test_every_output_has_one_outcome(spark, texts):
    graded = grade(_outputs(spark, texts))
    counts = oc.prompt_accuracy(graded, ["prompt_pos"]).agg(F.sum("total"), F.sum("answered")).first()
    assert (counts[0] or 0, counts[1] or 0) == (len(texts), sum(t is not None for t in texts))
    by_item = oc.item_outcomes(graded).agg(F.sum(F.col("n_correct") + F.col("n_wrong") + F.col("n_failed"))).first()[0]
    assert (by_item or 0) == len(texts)
    for r in oc.item_outcomes(graded).collect():
        assert (len(r.correct_prompts), len(r.wrong_prompts)) == (r.n_correct, r.n_wrong)


@settings(**_QUIET)
@given(st.lists(_TEXTS, max_size=40))
def test_result_maps_hold_the_last_answer_of_each_text(spark, texts):
    graded = grade(_outputs(spark, texts))
    want = {}
    for r in graded.orderBy("prompt_pos").collect():
        if r.outcome != "failed":
            want.setdefault((r.run_id, r.item_id), {})[r.prompt] = r.outcome == "correct"
    assert {(r.run_id, r.item_id): r.res for r in oc.item_result_map(graded).collect()} == want


@settings(**_QUIET)
@given(st.lists(_TEXTS, max_size=30), st.integers(0, 4))
def test_pairs_are_as_many_as_the_shorter_list(spark, texts, n):
    outcomes = oc.item_outcomes(grade(_outputs(spark, texts)))
    answer = "".join(f"<REWRITE_BEGIN>r{i}</REWRITE_END>" for i in range(n))
    pairs = rf.rewrite_pairs(outcomes, outcomes.select("run_id", "item_id", F.lit(answer).alias("response"))).collect()
    wrong = {(r.run_id, r.item_id): r.wrong_prompts for r in outcomes.collect()}
    assert sorted((p.run_id, p.item_id, p.pair_pos, p.old_prompt, p.new_prompt) for p in pairs) == sorted(
        (*k, i, old, f"r{i}") for k, ws in wrong.items() for i, old in enumerate(ws[:n]))


def test_pools_meet_all_their_items_under_skew(spark):
    items = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(1 + F.col("id") % 7).cast("long").alias("run_id"),
        F.col("id").alias("item_id"))
    prompts = ["a", "b"]
    assert ask_all(items, prompts).count() == 6000
    pools = ask_all(items.select("run_id").distinct(), prompts)
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = ask_pools(items, pools, ["run_id"])
        assert got.count() == 6000 and got.dropDuplicates(["item_id", "prompt"]).count() == 6000
