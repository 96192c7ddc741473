"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.models import MODELS, SETTINGS
from promptmill import schemas
from promptmill.functions import names
from promptmill.functions import text as tx
from promptmill.functions.grading import came_back, grade
from promptmill.operators import items as it
from promptmill.operators import outcomes as oc
from promptmill.operators import pools as pl
from promptmill.operators import refine as rf
from promptmill.operators import reports as rp
from promptmill.operators import requests as rq
from promptmill.operators import rules as rl
from promptmill.operators import usage as us
from promptmill.operators.completion import complete, complete_once
from promptmill.operators.ordered import lookup
from promptmill.plans import improvement, merging, publish, steps
from promptmill.plans.files import write_run
from promptmill.sources import results
from promptmill.sources import runs as st
from promptmill.streaming.outputs import start_grading
from promptmill.streaming.pools import last_round, start_improving
from promptmill.streaming.rules import all_chunks, start_chunks
from promptmill.streaming.usage import current_cost, start_totals
from promptmill.workspace import fresh_folder, spread, written

SUBSET_REQUESTS = ("all", " src1, src3 ,missing", "")
SLICES = ((5, 2), (0, 3), (2000, 1), (4, 0))
REWRITES, DISTILS, MERGES, PROMPTS = (
    "Give {num} blocks", "Cases:\n{pairs_block}\nGuideline:", "Rules:\n{rules_block}", "Make {num} of\n{rules_block}")
REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    REGISTERED[build.__name__] = build
    return build


def _graded(spark, sf_dir, grader="strict"):
    return grade(fx.outputs(spark, sf_dir), grader)


def _joined(column: str) -> F.Column:
    return F.array_join(column, " | ")


# Sources and items.

@query
def load_items(spark, sf_dir):
    choice = it.choice_items(fx.raw_choice_items(spark, sf_dir))
    untyped = fx.raw_math_items(spark, sf_dir).select(
        "pos", "question", "answer", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("source"))
    return it.with_defaults(
        choice.unionByName(it.math_items(fx.raw_math_items(spark, sf_dir))).unionByName(untyped))


@query
def held_out_items(spark, sf_dir):
    return it.answerable(it.held_out_items(fx.raw_choice_items(spark, sf_dir)), "ground_truth")


@query
def quarantined_items(spark, sf_dir):
    return it.unanswerable(it.choice_items(fx.raw_choice_items(spark, sf_dir))).select("pos", "source")


@query
def format_question(spark, sf_dir):
    return fx.raw_choice_items(spark, sf_dir).select(
        "pos", tx.choice_question(F.col("question"), F.col("choices")).alias("question"),
        tx.choice_letter(F.col("answer")).alias("answer"))


@query
def load_counts(spark, sf_dir):
    return it.load_counts(fx.items(spark, sf_dir))


@query
def subset_filter(spark, sf_dir):
    out = None
    for requested in SUBSET_REQUESTS:
        kept = it.filter_subsets(fx.items(spark, sf_dir), requested).groupBy("subset").agg(
            F.count("*").alias("n_items")).withColumn("requested", F.lit(requested))
        out = kept if out is None else out.unionByName(kept)
    return out


@query
def subset_slice(spark, sf_dir):
    out = None
    for limit, offset in SLICES:
        kept = it.slice_subsets(fx.items(spark, sf_dir), limit, offset, position="item_id").select(
            F.lit(limit).alias("lim"), F.lit(offset).alias("off"), "subset", "item_id")
        out = kept if out is None else out.unionByName(kept)
    return out


@query
def item_index(spark, sf_dir):
    return it.with_item_index(fx.items(spark, sf_dir).select("subset", "item_id"), position="item_id")


@query
def head_tail_sample(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    # Items are cut down without their text, which then joins the few that are left.
    whole = items.select("subset", "item_id", F.lit(1).alias("whole"))
    kept = written(it.both_ends(whole, ["whole"], ["subset", "item_id"]).drop("whole"), "kept")
    return items.join(kept, ["subset", "item_id"]).select("item_index", "item_id", "subset", "question")


# Requests.

@query
def prompt_item_cross(spark, sf_dir):
    return rq.ask_all(fx.items(spark, sf_dir).select("run_id", "item_id"), rq.SEED_PROMPTS)


@query
def render_requests(spark, sf_dir):
    asked = rq.ask_all(fx.items(spark, sf_dir), rq.SEED_PROMPTS).select("item_id", "prompt_pos", "prompt", "question")
    # One pass over the rows for both placements, not one each.
    both = [F.struct(F.lit(p).alias("placement"), s.alias("system"), u.alias("user"))
            for p in ("pool", "system") for s, u in [rq.request(F.col("prompt"), F.col("question"), p)]]
    return asked.select("item_id", "prompt_pos", F.inline(F.array(*both)))


# Reading answers and grading.

def _texts(spark, sf_dir):
    """Every output, document and conversation turn, whole."""
    outputs = fx.outputs(spark, sf_dir).selectExpr(
        "'output' as kind", "item_id as id", "cast(prompt_pos as bigint) as pos", "raw_output as text")
    documents = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").selectExpr(
        "'document'", "doc_id", "cast(0 as bigint)", "text")
    turns = fx.table(spark, sf_dir, "conversations").selectExpr("'turn'", "conv_id", "turn", "text")
    return outputs.union(documents).union(turns)


@query
def extract_number(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", "pos", tx.last_number(F.col("text")).alias("number"))


@query
def extract_choice_strict(spark, sf_dir):
    return tx.with_strict_choice(_texts(spark, sf_dir), "text", "choice").select("kind", "id", "pos", "choice")


@query
def extract_choice_loose(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", "pos", tx.loose_choice(F.col("text")).alias("choice"))


@query
def grade_outputs(spark, sf_dir):
    both = grade(_graded(spark, sf_dir), "loose", out="loose_outcome")
    return both.select("run_id", "item_id", "prompt_pos", "type", "outcome", "loose_outcome")


@query
def answered_outputs(spark, sf_dir):
    return grade(came_back(fx.outputs(spark, sf_dir))).select(
        "run_id", "item_id", "prompt_pos", "raw_output", "outcome")


@query
def grader_agreement(spark, sf_dir):
    return oc.grader_agreement(fx.outputs(spark, sf_dir))


# Outcomes and reports.

@query
def item_outcomes(spark, sf_dir):
    return oc.item_outcomes(_graded(spark, sf_dir)).select(
        "run_id", "item_id", _joined("correct_prompts").alias("correct_prompts"),
        _joined("wrong_prompts").alias("wrong_prompts"), "n_correct", "n_wrong", "n_failed")


def _with_repeats(graded):
    """Graded outputs of a pool that holds every prompt's text twice, for the first time in capitals."""
    again = graded.withColumns({"prompt_pos": F.col("prompt_pos") + 5, "prompt": F.upper("prompt")})
    later = again.withColumns({
        "prompt_pos": F.col("prompt_pos") + 5,
        "outcome": F.when(F.col("item_id") % 2 == 0, F.lit("wrong")).otherwise(F.col("outcome"))})
    return graded.unionByName(again).unionByName(later)


@query
def item_result_map(spark, sf_dir):
    return oc.item_result_map(_with_repeats(_graded(spark, sf_dir))).select(
        "run_id", "item_id", F.to_json("res").alias("res"))


@query
def prompt_accuracy(spark, sf_dir):
    return oc.prompt_accuracy(_graded(spark, sf_dir))


@query
def prompt_leaderboard(spark, sf_dir):
    return oc.prompt_leaderboard(oc.prompt_accuracy(_graded(spark, sf_dir))).select(
        "run_id", "prompt_pos", "accuracy", "rank", "is_best")


def _report_blocks(spark, sf_dir):
    accuracy = oc.prompt_accuracy(_graded(spark, sf_dir, "loose"))
    headers = fx.items(spark, sf_dir).groupBy("run_id").agg(
        F.concat(F.lit("['"), F.expr("listagg(distinct subset, ''', ''') within group (order by subset)"),
                 F.lit("']")).alias("subjects")
    ).withColumns({"model": F.lit("small:7b"), "split": F.lit("validation")})
    return rp.report_blocks(accuracy, headers)


@query
def eval_report_lines(spark, sf_dir):
    return rp.report_lines(_report_blocks(spark, sf_dir))


@query
def eval_report_parse(spark, sf_dir):
    folder = fresh_folder(spark, "reports")
    results.write_reports(_report_blocks(spark, sf_dir), folder)
    return results.read_reports(spark, folder).select(
        F.regexp_extract("path", r"run_id=(\d+)", 1).cast("long").alias("run_id"),
        "prompt_no", "percent", "correct", "total", "label")


def _run_names(spark, sf_dir):
    """A name per run of the items, from its number of subsets and items."""
    runs = fx.items(spark, sf_dir).groupBy("run_id").agg(
        F.expr("listagg(distinct subset, ',') within group (order by subset)").alias("subsets"),
        F.count("*").alias("n"))
    even = F.col("run_id") % 2 == 0
    name = names.run_name(
        F.lit("small:7b-x"), F.lit("large:32b-x"), F.lit("mmlu"),
        F.when(F.col("run_id") == 0, "all").otherwise(F.col("subsets")),
        F.when(even, F.col("n")).otherwise(-1), ~even, F.lit(5),
        F.make_timestamp_ntz(F.lit(2025), F.lit(12), F.lit(13), F.lit(16), F.col("run_id").cast("int"), F.lit(14)))
    return runs.select("run_id", F.concat(F.lit("runs/"), name).alias("path"))


def _saved_prompts(paths):
    """Saved prompts of the runs: ever fewer, and none for the last."""
    return rq.ask_all(paths, rq.SEED_PROMPTS).where("length(prompt) > 30 + 15 * run_id")


@query
def run_catalog(spark, sf_dir):
    paths = _run_names(spark, sf_dir)
    return rp.run_catalog(paths, _saved_prompts(paths)).withColumn(
        "started", F.date_format(F.to_timestamp_ntz("started", F.lit(names.TIME)), "yyyy-MM-dd HH:mm:ss"))


@query
def evaluable_runs(spark, sf_dir):
    paths = _run_names(spark, sf_dir)
    return rp.evaluable_runs(paths, _saved_prompts(paths))


@query
def evaluated_runs(spark, sf_dir):
    """Held-out results, named in the older way, with the run they came from."""
    runs = _run_names(spark, sf_dir).select(F.col("path").alias("run_path"), *names.run_parts(F.col("path")))
    files = rp.run_scores(oc.prompt_accuracy(_graded(spark, sf_dir, "loose"))).join(
        _run_names(spark, sf_dir).select("run_id", F.regexp_extract("path", r"(\d{8}-\d{6})$", 1).alias("at")), "run_id")
    evaluated = files.withColumn("path", F.concat(
        F.lit("eval/small-7b-x_large-32b-x_Limit100_IterOn_5_"), "at", F.lit("_validation_eval.txt"))).select(
        "run_id", "mean_accuracy", "best_accuracy", "best_prompt", *names.run_parts(F.col("path")))
    return rp.with_training_run(evaluated, runs).select("run_id", "run_path", "mean_accuracy", "best_accuracy", "best_prompt")


@query
def matched_runs(spark, sf_dir):
    """The same where runs share a second and reports, named in the older way, tell a time 3 seconds later."""
    def at(second):
        return F.format_string(f"16%02d{second}", F.floor(F.col("run_id") / 2))
    named = _run_names(spark, sf_dir)
    runs = named.select(F.concat(F.regexp_replace("path", r"\d{6}$", ""), at(14)).alias("run_path"))
    runs = runs.select("run_path", *names.run_parts(F.col("run_path")))
    parts = named.select("run_id", *names.run_parts(F.col("path")))
    old = parts.select("run_id", F.concat(
        F.lit("eval/small-7b-x_large-32b-x_Limit"), F.col("limit").cast("string"), F.when(F.col("mode") == "Iter", "_IterOn_5_").otherwise("_IterOff_"),
        F.lit("20251213-"), at(17), F.lit("_validation_eval.txt")).alias("path"))
    scores = rp.run_scores(oc.prompt_accuracy(_graded(spark, sf_dir, "loose")))
    evaluated = lookup(scores, old, ["run_id"], "inner").select("*", *names.run_parts(F.col("path")))
    return rp.with_nearest_run(evaluated, runs, "run_id").select("run_id", "run_path", "mean_accuracy", "best_accuracy", "seconds_away")


@query
def stored_runs(spark, sf_dir):
    """Prompts found in stored run folders, with their results from the reports on runs of even number."""
    folder = fresh_folder(spark, "stored-runs")
    paths = _run_names(spark, sf_dir).withColumn("name", F.replace("path", F.lit("runs/"), F.lit("")))
    within = Window.partitionBy("run_id").orderBy("prompt_pos")  # a pool is a few rows a run
    saved = written(_saved_prompts(paths).withColumn("no", F.row_number().over(within)), "saved")
    lines = saved.groupBy("name").agg(F.expr(r"listagg(prompt, '\n') within group (order by no)").alias("value"))
    (paths.join(lines, "name", "left").select(F.col("name").alias("run"), F.lit("optimized_prompts").alias("file"), F.coalesce("value", F.lit("")).alias("value"))
     .write.partitionBy("run", "file").text(f"{folder}/runs"))
    told = oc.prompt_accuracy(_graded(spark, sf_dir, "loose")).where("run_id % 2 = 0").join(saved.select("run_id", "prompt_pos", "no", "name"), ["run_id", "prompt_pos"])
    headers = told.select("name").distinct().selectExpr("name", "'m' as model", "'validation' as split", "'all' as subjects")
    blocks = rp.report_blocks(told.withColumn("prompt_pos", F.col("no") - 1), headers, "name")
    (blocks.groupBy(F.concat("name", F.lit("_validation_eval")).alias("report")).agg(F.expr("listagg(text, '') within group (order by block)").alias("value"))
     .write.partitionBy("report").text(f"{folder}/reports"))
    return st.evaluated_prompts(spark, f"{folder}/runs", f"{folder}/reports").withColumn("prompt_no", F.col("prompt_no").cast("int"))


@query
def run_comparison(spark, sf_dir):
    scores = rp.run_scores(oc.prompt_accuracy(_graded(spark, sf_dir)))
    runs = _run_names(spark, sf_dir).select(
        "run_id", F.floor(F.col("run_id") / 2).alias("pair"), *names.run_parts(F.col("path")))
    return rp.run_comparison(scores, runs, "pair")


# Refining and verifying.

def _stored(spark, sf_dir):
    """Graded outputs as the table they are in a job: graded once, read by every step after."""
    return written(_graded(spark, sf_dir), "graded")


def _pairs(spark, sf_dir, graded):
    return rf.rewrite_pairs(oc.item_outcomes(graded), fx.responses(spark, sf_dir))


def _candidates(spark, sf_dir, graded):
    return rf.check_candidates(grade(fx.candidate_outputs(_pairs(spark, sf_dir, graded), fx.items(spark, sf_dir))))


@query
def failure_cases(spark, sf_dir):
    return rf.failure_cases(_graded(spark, sf_dir))


@query
def rewrite_requests(spark, sf_dir):
    return rf.rewrite_requests(rf.failure_cases(_graded(spark, sf_dir)), fx.items(spark, sf_dir), REWRITES)


@query
def extract_tags(spark, sf_dir):
    return tx.with_tag_blocks(fx.responses(spark, sf_dir), "response", "REWRITE", "bodies").select(
        "item_id", F.posexplode("bodies").alias("tag_pos", "body"))


@query
def rewrite_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, _graded(spark, sf_dir))


@query
def verified_pairs(spark, sf_dir):
    return rf.verified_pairs(_candidates(spark, sf_dir, _graded(spark, sf_dir)))


@query
def refinement_trace(spark, sf_dir):
    return rf.refinement_trace(_candidates(spark, sf_dir, _graded(spark, sf_dir)))


def _status(spark, sf_dir, compat=False):
    graded = _stored(spark, sf_dir)
    return rf.item_status(
        oc.item_outcomes(graded, keep=("subset",)), _candidates(spark, sf_dir, graded),
        keep=("subset",), compat=compat).withColumnRenamed("subset", "source")


@query
def status_table(spark, sf_dir):
    return _status(spark, sf_dir)


@query
def status_file(spark, sf_dir):
    folder = fresh_folder(spark, "status")
    rows = _status(spark, sf_dir, compat=True).withColumnRenamed("item_id", "id")
    results.write_csv(rows.select(*schemas.STATUS.names, "run_id"), folder)
    return results.read_status(spark, folder)


@query
def status_funnel(spark, sf_dir):
    return rf.status_funnel(_status(spark, sf_dir))


@query
def results_roundtrip(spark, sf_dir):
    folder = fresh_folder(spark, "results")
    maps = oc.item_result_map(_graded(spark, sf_dir))
    rows = fx.items(spark, sf_dir).join(maps, ["run_id", "item_id"]).select(
        F.col("item_id").alias("id"), F.col("subset").alias("source"), "type", F.col("question").alias("q"), "res",
        "run_id")
    results.write_json(rows, folder)
    # A second write of some runs replaces those runs only.
    results.write_json(results.read_json(spark, folder, schemas.DETAILED_RESULT).where("run_id = 1").transform(
        lambda df: written(df, "again")), folder, restart=True)
    return results.read_json(spark, folder, schemas.DETAILED_RESULT).withColumn("res", F.to_json("res"))


# Rules.

@query
def rule_requests(spark, sf_dir):
    graded = _stored(spark, sf_dir)
    return rl.rule_requests(
        rf.verified_pairs(_candidates(spark, sf_dir, graded)), rf.failure_cases(graded), DISTILS)


@query
def tier1_chunks(spark, sf_dir):
    return rl.tier1_chunks(fx.rules(spark, sf_dir))


@query
def merge_requests(spark, sf_dir):
    return rl.merge_requests(rl.tier1_chunks(fx.rules(spark, sf_dir)), ["run_id", "chunk"], MERGES)


@query
def merge_tree(spark, sf_dir):
    return rl.merge_tree(rl.tier1_chunks(fx.rules(spark, sf_dir).withColumn("rule_text", F.lit(""))))


@query
def rule_sections(spark, sf_dir):
    return rl.rule_sections(fx.rules(spark, sf_dir), ["run_id", "item_id"])


@query
def rule_consensus(spark, sf_dir):
    return rl.rule_consensus(fx.rules(spark, sf_dir), ["item_id"])


@query
def rule_log_blocks(spark, sf_dir):
    folder = fresh_folder(spark, "rule-log")
    blocks = fx.rules(spark, sf_dir).select(
        "run_id", F.col("item_id").alias("block_no"),
        results.rule_block(F.concat(F.lit("Sample "), F.col("item_id").cast("string")), F.col("rule_text"))
        .alias("value"))
    results.write_rule_log(blocks, folder)
    read = results.read_rule_log(spark, folder)
    return read.select(F.regexp_extract("path", r"run_id=(\d+)", 1).cast("long").alias("run_id"), "title", "body")


@query
def generation_requests(spark, sf_dir):
    return rl.generation_requests(fx.rules(spark, sf_dir), ["run_id", "item_id"], 8, PROMPTS)


@query
def generated_prompts(spark, sf_dir):
    return rl.generated_pool(fx.generated(spark, sf_dir), ["run_id", "item_id"], 8)


@query
def prompt_file_lines(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(
        "text", F.lit("\n\n  \\sss first\r\n\t"), "text", F.lit(" \n")).alias("value"))
    return files.select("doc_id", F.posexplode(tx.prompt_lines(F.col("value"))).alias("prompt_pos", "prompt"))


# Pools over time.

def _pools(spark, sf_dir):
    """The seed pool, and one per three items of a run; every fifteenth update made no prompt."""
    items = fx.items(spark, sf_dir)
    runs = items.select("run_id").distinct().withColumn("valid_from", F.lit(0).cast("long"))
    seed = rq.ask_all(runs, rq.SEED_PROMPTS)
    rules = items.select("run_id", "item_id", F.lit("").alias("rule_text"))
    starts = pl.pool_starts(rl.tier1_chunks(rules)).where("valid_from % 5 <> 0 or valid_from % 3 <> 0")
    made = starts.select(
        "run_id", "valid_from", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("prompt_pos"),
    ).withColumn("prompt", F.concat(F.lit("Pool "), "valid_from", F.lit(" prompt "), "prompt_pos"))
    return written(seed.unionByName(made), "pools")


@query
def prompt_pool_asof(spark, sf_dir):
    pools = _pools(spark, sf_dir)
    return pl.ask_pool_in_force(fx.items(spark, sf_dir).select("run_id", "item_id"), pools)


@query
def pool_intervals(spark, sf_dir):
    return pl.pool_intervals(_pools(spark, sf_dir))


@query
def prompt_history(spark, sf_dir):
    folder = fresh_folder(spark, "history")
    results.write_json(pl.history_rows(_pools(spark, sf_dir)), folder)
    return results.read_json(spark, folder, schemas.PROMPT_HISTORY).withColumn("prompts", _joined("prompts"))


# Usage.

@query
def usage_running(spark, sf_dir):
    return us.running_usage(fx.usage(spark, sf_dir)).select(
        "call_id", "run_id", "role", "prompt_so_far", "completion_so_far", "total_so_far")


@query
def cost_report(spark, sf_dir):
    return us.cost_report(fx.usage(spark, sf_dir), ["run_id", "role", "model"]).withColumn(
        "est_cost", F.col("est_cost").cast("double"))


@query
def cost_file(spark, sf_dir):
    folder = fresh_folder(spark, "cost")
    usage = fx.usage(spark, sf_dir)
    ended = usage.groupBy("run_id", "role").agg(F.max("ts").alias("ended"))
    report = us.cost_report(usage, ["run_id", "role", "model"])
    results.write_csv(results.cost_rows(report.join(ended, ["run_id", "role"])), folder)
    return results.read_cost(spark, folder).select(
        "run_id", F.col("Timestamp").alias("ended"), F.col("Role").alias("role"), F.col("Model").alias("model"),
        F.col("Total Tokens").alias("total_tokens"), F.col("`Est. Cost ($)`").cast("double").alias("est_cost"))


# Model calls and whole jobs.

@query
def model_calls(spark, sf_dir):
    asked = rq.with_request(rq.ask_all(fx.items(spark, sf_dir), rq.SEED_PROMPTS)).select(
        "item_id", "prompt_pos", "system", "user")
    return complete(asked, MODELS.scorer, retry_delay=0.0)


@query
def evaluate_pool(spark, sf_dir):
    asked = rq.ask_all(fx.items(spark, sf_dir), rq.SEED_PROMPTS)
    graded = steps.evaluate(asked, MODELS.scorer, SETTINGS)
    return oc.item_outcomes(graded).select(
        "run_id", "item_id", _joined("correct_prompts").alias("correct_prompts"), "n_correct", "n_wrong", "n_failed")


@query
def held_out_evaluation(spark, sf_dir):
    return steps.held_out(fx.items(spark, sf_dir), list(rq.SEED_PROMPTS), MODELS.scorer, SETTINGS)


@query
def resumed_calls(spark, sf_dir):
    """Half of the requests are answered, the job starts again over all of them: each is asked once."""
    store, keys = fresh_folder(spark, "answers"), ["item_id", "prompt_pos"]
    asked = rq.with_request(rq.ask_all(fx.items(spark, sf_dir), rq.SEED_PROMPTS)).select(*keys, "system", "user")
    complete_once(asked.where("item_id % 2 = 0"), MODELS.scorer, store, keys, piece_calls=400, retry_delay=0.0)
    answers = complete_once(asked, MODELS.scorer, store, keys, piece_calls=400, retry_delay=0.0)
    calls = spark.read.parquet(store).groupBy("request_id").agg(F.count("*").alias("n_calls"))
    return answers.join(calls, "request_id").select(*keys, "raw_output", "tries", "n_calls")


@query
def held_out_runs(spark, sf_dir):
    """Every run's own prompt file on its items, to reports and back; run 3 has no prompts."""
    folder = fresh_folder(spark, "held-out-runs")
    items = fx.items(spark, sf_dir)
    pools = rq.ask_all(items.select("run_id").distinct(), rq.SEED_PROMPTS).where("prompt_pos >= run_id and run_id < 3")
    results.write_prompts(pools, f"{folder}/optimized_prompts")
    own = results.read_prompts(spark, f"{folder}/optimized_prompts").select(
        F.regexp_extract("path", r"run_id=(\d+)", 1).cast("long").alias("run_id"), "prompt_pos", "prompt")
    accuracy = written(steps.held_out_runs(items, own, MODELS.scorer, SETTINGS), "accuracy")
    headers = items.select("run_id").distinct().selectExpr("run_id", "'m' as model", "'validation' as split", "'all' as subjects")
    results.write_reports(steps.held_out_report(accuracy, headers), f"{folder}/reports")
    return results.read_reports(spark, f"{folder}/reports").select(
        F.regexp_extract("path", r"run_id=(\d+)", 1).cast("long").alias("run_id"), "prompt_no", "correct", "total", "label")


def _improved(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    return steps.improve(rq.ask_all(items, rq.SEED_PROMPTS), items, MODELS, SETTINGS)


@query
def refine_and_verify(spark, sf_dir):
    return rf.refinement_trace(_improved(spark, sf_dir).candidates)


@query
def improvement_status(spark, sf_dir):
    return _improved(spark, sf_dir).status


@query
def extracted_rules(spark, sf_dir):
    return _improved(spark, sf_dir).rules


@query
def merged_rules(spark, sf_dir):
    chunks = written(rl.tier1_chunks(fx.rules(spark, sf_dir)), "chunks")
    tier1 = merging.merge_chunks(chunks, MODELS, SETTINGS)
    return merging.merge_balanced(tier1, MODELS, SETTINGS)[0]


@query
def prompts_from_rules(spark, sf_dir):
    return steps.generate(fx.rules(spark, sf_dir), ["run_id", "item_id"], 2, MODELS, SETTINGS)


@query
def full_run(spark, sf_dir):
    done = improvement.run_base(fx.items(spark, sf_dir), rq.SEED_PROMPTS, MODELS, SETTINGS)
    return lookup(done.final_rule, done.tier1.groupBy("run_id").agg(F.count("*").alias("n_merges")), ["run_id"]).join(
        done.final_prompts, "run_id", "left")


#: Rules of a chunk in the iterative queries, whose SQL plays one round a chunk.
ITERATIVE_GROUP = 9


@query
def full_run_iterative(spark, sf_dir):
    """Every item's status and the prompts it was asked, in runs whose pool is replaced after each chunk of rules."""
    done = improvement.run_iterative(fx.items(spark, sf_dir), rq.SEED_PROMPTS, MODELS, replace(SETTINGS, group_size=ITERATIVE_GROUP))
    return _statuses(done.status, done.graded)


def _statuses(status, graded):
    asked = graded.groupBy("run_id", "item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prompt_pos", "prompt"))), lambda x: x["prompt"]), " | ").alias("asked"))
    return status.select("run_id", "item_id", "source", "status", "initial_wrong", "verified_success", "note").join(asked, ["run_id", "item_id"])


@query
def iterative_pools(spark, sf_dir):
    """Exact iterative runs whose pools change: what was asked under another pool than the one in force, and pools out of place."""
    items = fx.items(spark, sf_dir)
    done = improvement.run_iterative(items, rq.SEED_PROMPTS, MODELS, replace(SETTINGS, group_size=12))
    pools = written(done.pools, "pools")
    asked = pl.ask_pool_in_force(items.select("run_id", "item_id"), pools).withColumn("due", F.lit(1))
    keys = ["run_id", "item_id", "prompt_pos", "prompt"]
    met = done.graded.select(*keys).withColumn("was", F.lit(1)).join(asked.select(*keys, "due"), keys, "full")
    told = met.groupBy("run_id").agg(F.count_distinct("item_id").alias("n_items"), F.count_if(F.expr("was is null or due is null")).alias("misplaced"))
    filled = done.tier1.where("not is_tail").select("run_id", (F.col("sample_idx") + 1).alias("valid_from"), F.lit(1).alias("filled"))
    late = (pools.where("valid_from > 0").select("run_id", "valid_from").distinct().join(filled, ["run_id", "valid_from"], "left")
            .groupBy("run_id").agg(F.count_if(F.col("filled").isNull()).alias("late")))
    return told.join(late, "run_id", "left").select("run_id", "n_items", "misplaced", F.coalesce("late", F.lit(0)).alias("late"))


# Streams. Each must give what its batch twin gives, so it is checked by the same SQL.

def _stream(spark, sf_dir, name):
    schema = fx.table(spark, sf_dir, name).schema
    # The source takes folders and patterns; a table may be either one file or a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_graded_outputs(spark, sf_dir):
    folder = fresh_folder(spark, "graded-stream")
    arriving = fx.answered(rq.ask_all(fx.from_documents(_stream(spark, sf_dir, "documents")), rq.SEED_PROMPTS))
    start_grading(arriving, f"{folder}/rows", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("run_id", "item_id", "prompt_pos", "raw_output", "outcome")


@query
def stream_tier1_chunks(spark, sf_dir):
    folder = fresh_folder(spark, "chunk-stream")
    running = start_chunks(fx.from_conversations(_stream(spark, sf_dir, "conversations")), folder, f"{folder}/log")
    running.awaitTermination()
    return all_chunks(spark, folder, running.lastProgress["batchId"])


@query
def stream_usage_cost(spark, sf_dir):
    folder, keys = fresh_folder(spark, "usage-stream"), ["run_id", "role", "model"]
    arriving = fx.from_events(_stream(spark, sf_dir, "events"))
    start_totals(arriving, keys, f"{folder}/totals", f"{folder}/log").awaitTermination()
    return current_cost(spark, f"{folder}/totals", keys).withColumn("est_cost", F.col("est_cost").cast("double"))


@query
def stream_improvement(spark, sf_dir):
    """The same as ``full_run_iterative``, items arriving in several batches."""
    folder = fresh_folder(spark, "improvement-stream")
    items = written(fx.items(spark, sf_dir), "items")
    # One file a batch, in order: files of a source are taken by the time they were left.
    bounds = items.agg(F.percentile("item_id", F.array(*(F.lit(p / 4) for p in range(1, 4))))).first()[0]
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = items.where(F.lit(True) if low is None else F.col("item_id") > low).where(F.lit(True) if high is None else F.col("item_id") <= high)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    settings = replace(SETTINGS, group_size=ITERATIVE_GROUP)
    running = start_improving(arriving, rq.SEED_PROMPTS, MODELS, settings, folder, f"{folder}/log")
    running.awaitTermination()
    done = improvement.tables_of(spark, folder, last_round(spark, folder, running.lastProgress["batchId"]))
    return _statuses(done["status"], done["graded"])


@query
def run_files(spark, sf_dir):
    """The status file a full run leaves, with all its other files written beside it."""
    folder = fresh_folder(spark, "run-files")
    items = fx.items(spark, sf_dir)
    settings = replace(SETTINGS, usage_folder=f"{folder}/usage")
    done = improvement.run_base(items, rq.SEED_PROMPTS, MODELS, settings)
    write_run(done, items, folder, results.read_usage(spark, f"{folder}/usage"), {"scorer": "small:7b", "optimizer": "large:32b"})
    return results.read_status(spark, f"{folder}/optimization_status").withColumnRenamed("id", "item_id")


@query
def published_runs(spark, sf_dir):
    """Status of published runs: all of them published, one published again, and a version that never was."""
    folder = fresh_folder(spark, "published-runs")
    items = fx.items(spark, sf_dir)
    done = improvement.run_base(items, rq.SEED_PROMPTS, MODELS, SETTINGS)
    publish.publish_run(done, items, folder)
    publish.publish_run(done, items.where("run_id = 1"), folder)
    publish.stage_run(done, items, folder)
    return publish.published(spark, folder, "optimization_status").withColumnRenamed("id", "item_id")
