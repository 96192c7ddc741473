"""Whole jobs against the run played one call at a time."""

import zlib
from collections import defaultdict
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import functions as F

from checks.models import SETTINGS
from promptmill.functions import templates as tp
from promptmill.operators.requests import HELPER, SEED_PROMPTS
from promptmill.plans import improvement, steps
from promptmill.plans.steps import Models
from tests.answers import optimizer, scorer

SEEDS = SEED_PROMPTS[:3]
MODELS = Models(lambda: scorer(), lambda: optimizer())
PAIRS = replace(SETTINGS, group_size=2)


def _items():
    """One run with most of the items, one with few, one with a single one."""
    sizes = {0: 26, 1: 5, 2: 1}
    rows = []
    for run, n in sizes.items():
        for i in range(n):
            kind = "math" if i % 11 == 3 else "general" if i % 13 == 5 else "multiple_choice"
            answer = {"math": "12", "general": "yes"}.get(kind, "AB"[i % 2])
            rows.append({"run_id": run, "item_id": 3 * i + run, "question": "q" * (i * 7 % 41), "answer": answer,
                         "type": kind, "subset": f"s{i % 3}"})
    return rows


@pytest.fixture(scope="module")
def items(spark):
    from promptmill.workspace import written
    schema = "run_id long, item_id long, question string, answer string, type string, subset string"
    return written(spark.createDataFrame([tuple(r.values()) for r in _items()], schema), "items")


def _told(call, system, user):
    try:
        return call(system, user).strip()
    except RuntimeError:
        return None


def _by_item(df, *columns):
    out = defaultdict(list)
    for r in df.orderBy("run_id", "item_id").collect():
        out[r.run_id, r.item_id].append(tuple(r[c] for c in columns))
    return out


def _merged(texts):
    block = "\n\n".join(f"Rule {i}:\n{t}" for i, t in enumerate(texts, 1))
    return _told(optimizer(), tp.MERGE_TEMPLATE.replace("{rules_block}", block), tp.MERGE_MESSAGE)


def _made(rule, count):
    """The prompts that the varied optimizer makes of a rule: its answer's number in three lines, or none."""
    said = _told(optimizer(), tp.GENERATE_TEMPLATE.replace("{num}", str(count)).replace("{rules_block}", rule), tp.generate_message(count))
    if said.startswith("Here is"):
        return []
    n = said.split("about ")[1].split()[0]
    return [f"Think about {n} things", f"Verify all of the {n} parts", f"Explain step {n}"][:count]


def _pools(done):
    out = defaultdict(lambda: defaultdict(list))
    for r in done.pools.orderBy("prompt_pos").collect():
        out[r.run_id][r.valid_from].append(r.prompt)
    return out


def _hold(done):
    """What each table of a run must be, given the tables it is made from."""
    given = {(r["run_id"], r["item_id"]): r for r in _items()}
    pools = _pools(done)
    graded = _by_item(done.graded, "prompt_pos", "prompt", "raw_output", "outcome")
    # Every item is asked under the pool in force, and each answer is the model's.
    assert set(graded) == set(given)
    for key, rows in graded.items():
        start = max(v for v in pools[key[0]] if v <= key[1])
        assert [r[1] for r in sorted(rows)] == pools[key[0]][start]
        for _, prompt, output, outcome in rows:
            assert output == _told(scorer(), HELPER, f"{prompt}\n\n{given[key]['question']}")
            assert (outcome == "failed") == (output is None)
            if given[key]["type"] == "multiple_choice" and output:
                assert (outcome == "correct") == (output[-2] == given[key]["answer"])
    # A status follows from the outcomes and pairs of its item.
    tried = _by_item(done.candidates, "old_prompt", "new_prompt", "verified", "pair_pos")
    said = {}
    for key, ((status, wrong, good),) in _by_item(done.status, "status", "initial_wrong", "verified_success").items():
        outcomes = [r[3] for r in graded[key]]
        assert wrong == outcomes.count("wrong") and good == sum(v for _, _, v, _ in tried[key])
        assert status == ("Success" if good else "Failed (Verification)" if tried[key] else "Failed (Refine Step)" if wrong
                          else "Skipped (All Correct)" if "correct" in outcomes else "Failed (No Response)")
        said[key] = status
        # The k-th rewrite answers the k-th wrong prompt.
        assert [o for o, _, _, _ in sorted(tried[key], key=lambda t: t[3])] == [
            r[1] for r in sorted(graded[key]) if r[3] == "wrong"][:len(tried[key])]
        for _, new, verified, _ in tried[key]:
            output = _told(scorer(), HELPER, f"{new}\n\n{given[key]['question']}")
            if given[key]["type"] == "multiple_choice":
                assert verified == (output is not None and output[-2] == given[key]["answer"])
    rules = defaultdict(list)
    for (run, item), ((text,),) in sorted(_by_item(done.rules, "rule_text").items()):
        assert said[run, item] == "Success"
        rules[run].append((item, text))
    # Rules of a run in item order, in pairs: each in one Tier-1 merge, stamped with the item that filled it.
    tier1 = defaultdict(list)
    for r in done.tier1.orderBy("run_id", "chunk").collect():
        tier1[r.run_id].append((r.sample_idx, r.is_tail, r.rule_text))
    assert tier1 == {run: [(pair[-1][0], len(pair) < 2, _merged([t for _, t in pair]))
                           for pair in (listed[i:i + 2] for i in range(0, len(listed), 2))] for run, listed in rules.items()}
    # Pairs of texts become one until one is left, and that is the final rule.
    merges = defaultdict(int)
    for r in done.merges.collect():
        merges[r.run_id] += 1
    final = {r.run_id: r.rule_text for r in done.final_rule.collect()}
    assert set(final) == set(tier1)
    assert {run: n for run, n in merges.items()} == {run: len(t) - 1 for run, t in tier1.items() if len(t) > 1}
    made = defaultdict(list)
    for r in done.final_prompts.orderBy("prompt_pos").collect():
        made[r.run_id].append(r.prompt)
    assert made == {run: p for run, text in final.items() if (p := _made(text, 8))}
    return said, tier1, pools, final


def test_base_run_balanced(items):
    said, tier1, pools, final = _hold(improvement.run_base(items, SEEDS, MODELS, PAIRS))
    assert {"Success", "Failed (Verification)", "Failed (Refine Step)"} <= set(said.values()) and len(tier1[0]) > 3
    assert all(list(p) == [0] for p in pools.values())
    for run, held in tier1.items():
        level = [t for _, _, t in held]
        while len(level) > 1:
            level = [_merged(level[i:i + 2]) if len(level[i:i + 2]) > 1 else level[i] for i in range(0, len(level), 2)]
        assert final[run] == level[0]


def test_base_run_left_deep(items):
    _, tier1, _, final = _hold(improvement.run_base(items, SEEDS, MODELS, replace(PAIRS, merge_order="left_deep")))
    for run, held in tier1.items():
        assert final[run] == reduce(lambda a, b: _merged([a, b]), [t for _, _, t in held])


def test_left_deep_folds_of_a_long_run(spark, tmp_path):
    """10,000 rules of one run beside short ones: every fold as the tree has it, in a bounded number of jobs, gone on with after a kill."""
    import os

    from promptmill.operators import rules as ops
    from promptmill.plans import merging
    from promptmill.workspace import written
    sizes = {0: 10_000, 1: 7, 2: 3, 3: 2, 4: 8}
    chunks = []
    for run, n in sizes.items():
        for c in range(-(-n // 3)):
            chunks.append((run, c, min(3, n - 3 * c), 3 * c + 2, f"t{run}-{c}"))
    tier1 = written(spark.createDataFrame(chunks, "run_id long, chunk long, n_rules long, sample_idx long, rule_text string"), "tier1")
    told = f"{tmp_path}/calls"

    def optimizer():
        def answer(system, user):
            with open(told, "a", encoding="utf-8") as file:
                file.write("x")
            if os.path.exists(f"{told}-armed") and os.path.getsize(told) > 800:
                raise SystemExit("killed")
            inputs = system.split("Rule 1:\n")[1].split("\n\n")
            return f"{zlib.crc32(system.encode())} of {sum(bool(t) for t in inputs)}"
        return answer

    settings = replace(SETTINGS, merge_order="left_deep", answers=f"{tmp_path}/store", fold_steps=500, merge_template="{rules_block}")
    models = Models(None, lambda: optimizer())
    open(f"{told}-armed", "w").close()
    with pytest.raises(Exception):
        merging.merge_all(tier1, models, settings)
    os.remove(f"{told}-armed")
    asked = os.path.getsize(told)
    final, merges = merging.merge_all(tier1, models, settings)
    again, folds = os.path.getsize(told) - asked, merges.count()
    # The first job of 500 folds was kept; the one in hand is made again.
    assert folds - 500 - 20 <= again <= folds - 500
    want = {}
    for run, n in sizes.items():
        held, made, tail = [], [], []
        for r, c, k, _, text in chunks:
            if r == run:
                (held if k == 3 else tail).append(text)
        waiting = []
        for text in held:
            waiting.append(text)
            while len(waiting) >= 3:
                made.append(optimizer()("\n\n".join(f"Rule {i}:\n{t}" for i, t in enumerate(waiting[:3], 1)), ""))
                waiting = [made[-1], *waiting[3:]]
        waiting += tail
        if len(waiting) > 1:
            made.append(optimizer()("\n\n".join(f"Rule {i}:\n{t}" for i, t in enumerate(waiting, 1)), ""))
            waiting = [made[-1]]
        want[run] = (waiting[0], sorted(made))
    got = defaultdict(list)
    for r in merges.collect():
        got[r.run_id].append(r.rule_text)
    assert {r.run_id: (r.rule_text, sorted(got[r.run_id])) for r in final.collect()} == want
    tree = ops.merge_tree(tier1, 3).where(F.col("tier").isin(ops.FOLD, ops.CONVERGENCE))
    assert tree.count() == folds


def test_iterative_run_is_exact_in_blocks(items):
    _, tier1, pools, _ = _hold(improvement.run_iterative(items, SEEDS, MODELS, PAIRS, block=20))
    # A full chunk's prompts are in force from the item after the one that filled it.
    for run, held in tier1.items():
        assert pools[run] == {0: list(SEEDS), **{item + 1: p for item, tail, text in held if not tail and (p := _made(text, 5))}}
    assert len(pools[0]) > 2


def test_calls_are_tried_again_and_then_left_as_failed(spark):
    def flaky():
        seen = {}

        def answer(system, user):
            seen[user] = seen.get(user, 0) + 1
            if user == "never" or (user == "third" and seen[user] < 3):
                raise ConnectionError(f"no {user}")
            return (f" {system}{user} ", 3, 4) if user == "third" else f" {system}{user} "
        return answer
    from promptmill.operators.completion import complete, usage_rows
    asked = spark.createDataFrame([(1, "s", "once"), (2, "s", "third"), (3, "s", "never")], "id long, system string, user string")
    got = complete(asked, lambda: flaky(), retry_delay=0.0, partitions=1)
    rows = {r.id: r for r in got.collect()}
    assert (rows[1].raw_output, rows[1].tries, rows[1].error, rows[1].prompt_tokens) == ("sonce", 1, None, None)
    assert (rows[2].raw_output, rows[2].tries, rows[2].completion_tokens) == ("sthird", 3, 4)
    assert (rows[3].raw_output, rows[3].tries, rows[3].error) == (None, 3, "ConnectionError: no never")
    assert [tuple(r) for r in usage_rows(got, "scorer", ["id"]).collect()] == [(2, "scorer", 3, 4)]


def test_held_out_counts_failed_calls(items):
    got = steps.held_out(items, list(SEEDS), MODELS.scorer, SETTINGS).collect()
    assert sum(r.total for r in got) == 32 * 3 and any(r.answered < r.total for r in got)
    for r in got:
        assert r.accuracy == r.correct / r.total


def test_run_files(spark, items, tmp_path):
    from promptmill import schemas
    from promptmill.plans.files import write_run
    from promptmill.sources import results
    settings = replace(PAIRS, merge_order="left_deep", usage_folder=f"{tmp_path}/usage")
    spark.createDataFrame([(1, "scorer", 10, 20), (1, "optimizer", 4, 5)],
                          "run_id long, role string, prompt_tokens long, completion_tokens long") \
        .write.parquet(f"{tmp_path}/usage")
    done = improvement.run_base(items, SEEDS, MODELS, settings)
    said, tier1, _, final = _hold(done)
    out = f"{tmp_path}/out"
    for _ in range(2):  # written again, nothing is there twice
        write_run(done, items, out, spark.read.parquet(f"{tmp_path}/usage"), {"scorer": "s"})
    shown = {(0, 3 * i) for i in (*range(10), *range(16, 26))} | {(1, 3 * i + 1) for i in range(5)} | {(2, 2)}
    details = results.read_json(spark, f"{out}/detailed_results", schemas.DETAILED_RESULT).collect()
    answered = {key for key, status in said.items() if status != "Failed (No Response)"}
    assert sorted((r.run_id, r.id) for r in details) == sorted(shown & answered)
    status = results.read_status(spark, f"{out}/optimization_status").orderBy("run_id", "id").collect()
    assert {(r.run_id, r.id): r.status for r in status} == said
    trace = results.read_json(spark, f"{out}/refinement_trace", schemas.REFINEMENT_TRACE)
    assert {(r.run_id, r.id) for r in trace.collect()} <= shown
    log = results.read_rule_log(spark, f"{out}/rules_history").where("path like '%run_id=0%'")
    titles = [r.title for r in log.orderBy("path", "block_pos").collect()]
    n = len(tier1[0])
    full = [(item, text) for item, tail, text in tier1[0] if not tail]
    assert titles.count("Tier-1 Merge") == len(full) and titles.count("Recursive Merge") == n - 1 and titles[-1] == "FINAL RULE"
    first = titles.index("Tier-1 Merge")
    assert titles[first + 1] != "Recursive Merge" and all(t.startswith("Sample ") for t in titles[:first])
    evolution = results.read_json(spark, f"{out}/rule_evolution", schemas.RULE_EVOLUTION).where("run_id = 0").collect()
    assert sorted((int(r.sample_idx), r.rule_content) for r in evolution if r.tier == "Tier-1") == full
    assert len(evolution) >= 2 * n - 1 and {r.sample_idx for r in evolution if r.tier == "Convergence"} <= {"FINAL"}
    prompts = results.read_prompts(spark, f"{out}/optimized_prompts").where("path like '%run_id=0%'").orderBy("prompt_pos")
    assert [r.prompt for r in prompts.collect()] == _made(final[0], 8)
    assert spark.read.text(f"{out}/final_rule", wholetext=True).where("run_id = 0").first()[0].rstrip("\n") == final[0]
    cost = results.read_cost(spark, f"{out}/cost_report").collect()
    assert {(r.Role, r.Model, r["Total Tokens"]) for r in cost} == {("scorer", "s", 30), ("optimizer", None, 9)}
    history = results.read_json(spark, f"{out}/prompt_history", schemas.PROMPT_HISTORY).collect()
    assert {(r.event, tuple(r.prompts), r["count"]) for r in history} == {("initial_load", SEEDS, 3)}


def test_a_run_written_again_leaves_nothing_of_before(spark, items, tmp_path):
    from promptmill.sources import results
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        schema, path = "run_id long, prompt_pos int, prompt string", f"{tmp_path}/prompts"
        both = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (1, 1, "c")], schema)
        results.write_prompts(both, path)
        fewer = both.where("run_id = 1 and prompt_pos = 0")
        results.clear_runs(path, fewer)
        results.write_prompts(fewer, path)
        assert sorted(r.prompt for r in results.read_prompts(spark, path).collect()) == ["a", "b"]
        results.clear_runs(path, fewer)
        results.write_prompts(both.where("run_id = 7"), path)
        assert [r.prompt for r in results.read_prompts(spark, path).collect()] == ["a"]
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
