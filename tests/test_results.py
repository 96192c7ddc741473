"""Result files written and read back, and files as runs leave them."""

from pyspark.sql import functions as F

from promptmill import schemas
from promptmill.operators import outcomes as oc
from promptmill.operators import refine as rf
from promptmill.operators import reports as rp
from promptmill.operators.usage import cost_report
from promptmill.sources import items as src
from promptmill.sources import results


def test_items_from_files(spark, tmp_path):
    raw = [("b", i, f"q{i}", ["x", "y"], i % 5 - 1) for i in range(6)] + [("a", 0, "q", ["x"], 0), ("all", 0, "q", [], 0)]
    df = spark.createDataFrame(raw, schemas.RAW_CHOICE_ITEM)
    for fmt in ("parquet", "json"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        got = src.read_choice_items(spark, f"{tmp_path}/{fmt}", fmt, "all", limit=2, offset=1)
        assert {(r.source, r.pos, r.answer) for r in got.collect()} == {("mmlu_b", 1, "A"), ("mmlu_b", 2, "B")}
        held = src.read_held_out_items(spark, f"{tmp_path}/{fmt}", fmt, ["a", "none"])
        assert [tuple(r) for r in held.collect()] == [(0, "q\n(A) x\nAnswer:", "A", "multiple_choice", "a")]
    spark.createDataFrame([(0, "q", "#### 4"), (1, "r", "5")], schemas.RAW_MATH_ITEM).write.parquet(f"{tmp_path}/math")
    got = src.read_math_items(spark, f"{tmp_path}/math", limit=1, offset=1).collect()
    assert [tuple(r) for r in got] == [(1, "r", "5", "math", "gsm8k")]


def test_subset_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("b", 0, "q", ["x"], 0)], schemas.RAW_CHOICE_ITEM).write.parquet(f"{tmp_path}/p")
    plan = src.read_held_out_items(spark, f"{tmp_path}/p", subjects=["b"])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(subset,b)]" in plan.replace("IsNotNull(subset), ", "")


def test_json_results_keep_text_and_replace_runs(spark, tmp_path):
    rows = [(i, "s", "math", "naïve 中 \"q\"\n", {"p é": True, "r": False}, i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, results._with_run(schemas.DETAILED_RESULT))
    path = f"{tmp_path}/detail"
    results.write_json(df, path)
    results.write_json(df.where("id = 0").withColumn("id", F.lit(9).cast("long")), path)
    assert results.read_json(spark, path, schemas.DETAILED_RESULT).count() == 5
    results.write_json(df.where("run_id = 0"), path, restart=True)
    got = results.read_json(spark, path, schemas.DETAILED_RESULT)
    assert sorted(map(tuple, got.drop("res").collect())) == sorted(map(tuple, df.drop("res").collect()))
    assert got.first().res == {"p é": True, "r": False}
    assert "中" in spark.read.text(path).first()[0]


def test_recorded_json_lines(spark, tmp_path):
    (tmp_path / "run_id=1").mkdir()
    (tmp_path / "run_id=1" / "a.jsonl").write_text(
        '{"sample_idx": 13, "tier": "Tier-1", "rule_content": "x"}\n'
        '{"sample_idx": "FINAL", "tier": "Convergence", "rule_content": "y"}\n')
    got = results.read_json(spark, str(tmp_path), schemas.RULE_EVOLUTION).collect()
    assert {(r.sample_idx, r.tier, r.run_id) for r in got} == {("13", "Tier-1", 1), ("FINAL", "Convergence", 1)}


def test_status_files(spark, tmp_path):
    (tmp_path / "run_id=3").mkdir()
    with open(tmp_path / "run_id=3" / "s.csv", "w", newline="") as f:
        f.write("id,source,status,initial_wrong,verified_success,note\r\n0,mmlu_a,Skipped (All Correct),0,0,\r\n"
                "1,mmlu_a,Failed (Verification),5,0,All candidates failed\r\n")
    read = results.read_status(spark, str(tmp_path))
    want = {(0, "mmlu_a", "Skipped (All Correct)", 0, 0, "", 3),
            (1, "mmlu_a", "Failed (Verification)", 5, 0, "All candidates failed", 3)}
    assert set(map(tuple, read.collect())) == want
    results.write_csv(read, f"{tmp_path}/again")
    assert set(map(tuple, results.read_status(spark, f"{tmp_path}/again").collect())) == want


def test_recorded_cost(spark, tmp_path):
    usage = spark.createDataFrame([(1, "optimizer", "large", 490766, 176108), (1, "scorer", "small", 960417, 2025942),
                                   (1, "other", "x", 5, 5)],
                                  "run_id long, role string, model string, prompt_tokens long, completion_tokens long")
    report = cost_report(usage, ["run_id", "role", "model"])
    assert {(r.role, r.total_tokens, str(r.est_cost)) for r in report.collect()} == {
        ("optimizer", 666874, "2.98800"), ("scorer", 2986359, "0.00000"), ("other", 10, "0.00000")}
    rows = results.cost_rows(report.withColumn("ended", F.to_timestamp_ntz(F.lit("2025-12-13 20:56:21"))))
    results.write_csv(rows, f"{tmp_path}/cost")
    got = results.read_cost(spark, f"{tmp_path}/cost").where("Role = 'optimizer'").first()
    assert (got["Timestamp"], got["Input Tokens"], str(got["Est. Cost ($)"])) == ("2025-12-13 20:56:21", 490766, "2.98800")


def test_rule_log(spark, tmp_path):
    text = "\n".join([
        "", "========== Sample 2 (mmlu_x) ==========", "Successful Refinements:", "   [Original X] a", "", "Done", "",
        "========== Tier-1 Merge ==========", "---", "[Guiding Tone]", "Calm", "", "========== FINAL RULE ==========", "", ""])
    (tmp_path / "run_id=0").mkdir()
    (tmp_path / "run_id=0" / "log.txt").write_text(text)
    got = results.read_rule_log(spark, str(tmp_path)).orderBy("block_pos").collect()
    assert [(r.block_pos, r.title, r.body) for r in got] == [
        (0, "Sample 2 (mmlu_x)", "Successful Refinements:\n   [Original X] a\n\nDone"),
        (1, "Tier-1 Merge", "---\n[Guiding Tone]\nCalm"), (2, "FINAL RULE", "")]


def test_rule_log_pieces_stay_in_order(spark, tmp_path):
    blocks = spark.range(3000).select(
        F.lit(0).alias("run_id"), F.col("id").alias("block_no"),
        results.rule_block(F.concat(F.lit("T"), F.col("id")), F.repeat(F.lit("line\n"), 20)).alias("value"))
    results.write_rule_log(blocks.coalesce(1), f"{tmp_path}/log")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        got = results.read_rule_log(spark, f"{tmp_path}/log")
        assert got.count() == 3000
        for path in [r.path for r in got.select("path").distinct().collect()]:
            rows = got.where(F.col("path") == path).orderBy("block_pos").collect()
            assert [r.block_pos for r in rows] == list(range(len(rows)))
            numbers = [int(r.title[1:]) for r in rows]
            assert numbers == sorted(numbers)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prompt_files(spark, tmp_path):
    pools = spark.createDataFrame([(1, 1, "second é"), (1, 0, "first"), (2, 0, "only")],
                                  "run_id long, prompt_pos int, prompt string")
    results.write_prompts(pools, f"{tmp_path}/p")
    got = results.read_prompts(spark, f"{tmp_path}/p").collect()
    assert {(r.path.split("run_id=")[1][0], r.prompt_pos, r.prompt) for r in got} == {
        ("1", 0, "first"), ("1", 1, "second é"), ("2", 0, "only")}


def test_report_as_recorded(spark, tmp_path):
    accuracy = spark.createDataFrame(
        [(1, 0, "Outline the process.", 82, 253), (1, 7, "y" * 120, 0, 253)],
        "run_id long, prompt_pos int, prompt string, correct long, total long")
    headers = spark.createDataFrame([(1, "m:7b", "validation", "['a', 'b']")],
                                    "run_id long, model string, split string, subjects string")
    blocks = rp.report_blocks(accuracy, headers)
    results.write_reports(blocks, f"{tmp_path}/r")
    (folder,) = (tmp_path / "r").glob("run_id=1")
    (text,) = [f.read_text() for f in folder.glob("part-*")]
    assert text == (
        "Evaluation Report\nModel: m:7b\nData Split: validation (Full)\nSubjects: ['a', 'b']\n\n"
        "Prompt #1 Accuracy: 32.41% (82/253)\nPrompt: Outline the process....\n------------------------------\n"
        f"Prompt #8 Accuracy: 0.00% (0/253)\nPrompt: {'y' * 100}...\n------------------------------\n")
    got = results.read_reports(spark, f"{tmp_path}/r").collect()
    assert {(r.prompt_no, r.percent, r.correct, r.total, r.label) for r in got} == {
        (1, 32.41, 82, 253, "Outline the process...."), (8, 0.0, 0, 253, "y" * 100 + "...")}


def test_recorded_lift(spark):
    base, iterated = (82, 83, 77, 82, 82, 39, 0, 0), (92, 75, 85, 71, 88, 86, 95, 87)
    accuracy = spark.createDataFrame(
        [(run, i, f"p{i}", c, 253) for run, counts in enumerate((base, iterated)) for i, c in enumerate(counts)],
        "run_id int, prompt_pos int, prompt string, correct long, total long",
    ).withColumn("accuracy", F.col("correct") / F.col("total"))
    runs = spark.createDataFrame([(0, "x", "Base"), (1, "x", "Iter")], "run_id int, pair string, mode string")
    got = rp.run_comparison(rp.run_scores(accuracy), runs, "pair").first()
    shown = [f"{100 * got[c]:.2f}" for c in ("base_mean", "iter_mean", "base_best", "iter_best")]
    assert shown == ["21.99", "33.55", "32.81", "37.55"]
    best = oc.prompt_leaderboard(accuracy).where("is_best").orderBy("run_id").collect()
    assert [r.prompt_pos for r in best] == [1, 6]


def test_candidate_check_by_text(spark):
    rows = [(0, "o", "same", "correct", "ok"), (1, "o2", "same", "wrong", "bad"), (2, "o3", "lost", "failed", None),
            (3, "o4", "no", "wrong", "x1"), (4, "o5", "no", "wrong", "x2"), (5, "o6", "fine", "correct", "ok")]
    df = spark.createDataFrame([(0, 7, "s", *r) for r in rows],
                               "run_id long, item_id long, subset string, pair_pos int, old_prompt string, "
                               "new_prompt string, outcome string, raw_output string")
    got = {r.pair_pos: (r.verified, r.model_output) for r in rf.refinement_trace(rf.check_candidates(df)).collect()}
    assert got == {0: (True, "bad"), 1: (True, "bad"), 2: (False, "No Output"), 3: (False, "x2"), 4: (False, "x2"),
                   5: (True, "Correct")}


def test_status_rules_in_order(spark):
    outcomes = spark.createDataFrame([(0, i, c, w) for i, (c, w) in enumerate([(3, 0), (0, 0), (1, 2), (1, 2), (0, 3)])],
                                     "run_id long, item_id long, n_correct long, n_wrong long")
    tried = spark.createDataFrame([(0, 3, False), (0, 4, True), (0, 4, False)],
                                  "run_id long, item_id long, verified boolean")
    got = [(r.status, r.initial_wrong, r.verified_success, r.note)
           for r in rf.item_status(outcomes, tried).orderBy("item_id").collect()]
    assert got == [
        ("Skipped (All Correct)", 0, 0, ""), ("Failed (No Response)", 0, 0, ""),
        ("Failed (Refine Step)", 2, 0, "No suggestions from optimizer"),
        ("Failed (Verification)", 2, 0, "All candidates failed"), ("Success", 3, 1, "")]
    compat = rf.item_status(outcomes, tried, compat=True).where("item_id = 1").first()
    assert compat.status == "Skipped (All Correct)"
