"""Exact rounds of iterative runs, each a single job.

Pools follow one another: what a pool is made of was answered under the one before it. A long run therefore
takes very many rounds over few items each, and what a round costs besides its calls decides.
A round here keeps an item in one row, its calls in lists, so that the steps of ``plans.steps`` follow one another
inside a task. Rows meet once, by run, where the rules of a chunk are merged; one table is written.
Rounds of a run that would each be one task are played in one go, as a stretch (``plans.stretches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.functions import templates as tp
from promptmill.functions import text as tx
from promptmill.functions.grading import CORRECT, WRONG, graded_all
from promptmill.operators import refine, requests, rules
from promptmill.operators.completion import list_completer
from promptmill.operators.ordered import with_ordinal
from promptmill.operators.outcomes import ITEM
from promptmill.plans.steps import Models, Settings
from promptmill.plans.stretches import player
from promptmill.workspace import deleted, folders, fresh_folder, written

#: Items of a run that lie in one folder, and the most that a round or a stretch takes of a run.
PART, MOST = 250, 10_000
#: Items of a round that are not dealt to more tasks, and runs, unless ``Settings.partitions`` asks for as many.
TASK_ITEMS, TASK_RUNS = 500, 100
#: Runs up to which each is given a task of a stretch by its number; more are dealt by hash.
NUMBERED_RUNS = 10_000

#: What a job hands to the next, a row a run: the pool in force, the rules that wait for a chunk, how many chunks were
#: made, and where the run stands in its items, of which ``n_earlier`` came in earlier parts of the job. ``n_rounds`` were
#: played of the run by the last job.
_STATE = """is_run boolean, run_id long, state struct<next long, n_items long, width long, n_earlier long, n_chunks long,
    pool array<struct<prompt_pos int, prompt string>>, waiting array<struct<item_id long, rule_text string>>, is_new boolean, n_rounds long>"""
_TABLE = "played"
_CALL = ("tries", "error", "prompt_tokens", "completion_tokens")


def is_played(spark: SparkSession, base: str) -> bool:
    return _TABLE in folders(spark, base)


def _played(spark: SparkSession, base: str, n: int) -> DataFrame:
    # A part of the job played again may have taken fewer rounds than before.
    return spark.read.parquet(f"{base}/{_TABLE}").where(F.col("round") <= n).drop("round")


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """The first rounds of the jobs that left rows in ``base``."""
    return [int(name.rpartition("=")[2]) for name in folders(spark, f"{base}/{_TABLE}") if name.startswith("round=")]


def _state(spark: SparkSession, base: str, n: int) -> DataFrame:
    """Rows of the runs as the job that played round ``n`` in ``base`` left them; none before the first."""
    if n == 0:
        return spark.createDataFrame([], _STATE)
    first = max(number for number in _numbers(spark, base) if number <= n)
    return spark.read.schema(_STATE).parquet(f"{base}/{_TABLE}/round={first}").where("is_run and state is not null")


def left_of(spark: SparkSession, base: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Rules that wait after round ``n``, and the chunks made of every run."""
    state = _state(spark, base, n)
    return state.select("run_id", F.inline("state.waiting")), state.select("run_id", "state.n_chunks")


def tables(spark: SparkSession, base: str, n: int) -> dict[str, DataFrame]:
    """The tables of a run as rounds up to ``n`` left them in ``base``."""
    played = _played(spark, base, n)
    items, runs = played.where("not is_run"), played.where("is_run")
    own = played.select("item.*").columns
    said = items.select("run_id", "item_id", "item.*", "graded", "candidates", "status", "rule_text")
    return {
        "graded": said.select(*ITEM, *own, F.inline("graded")),
        "candidates": said.select(*ITEM, *own, F.inline("candidates")),
        "status": said.select(*ITEM, F.col("subset").alias("source"), "status.*"),
        "rules": said.where("rule_text is not null").select(*ITEM, "rule_text"),
        "tier1": runs.where("tier1 is not null").select("run_id", "tier1.*"),
        "pools": runs.select("run_id", F.inline("pools")),
    }


Step = dict[str, Column]


def _scored(prompts: str, field: str) -> Column:
    """Requests of the row's question under every prompt of a list."""
    def one(p: Column) -> Column:
        system, user = requests.request(p[field], F.col("question"), "pool")
        return F.struct(system.alias("system"), user.alias("user"))
    return F.transform(prompts, one)


def _asked_if(condition: Column, system: Column, user: Column) -> Column:
    """One request, or none."""
    return F.when(condition, F.array(F.struct(system.alias("system"), user.alias("user")))).otherwise(
        F.array().cast("array<struct<system string, user string>>"))


def _text(answers: str) -> Column:
    """The answer to one request; null for none."""
    return F.get(answers, F.lit(0))["text"]


def _with_outcomes(of: str, fields: tuple[str, ...], answers: str) -> Column:
    """A list of what was asked for with its answers and their outcomes."""
    def one(x: Column) -> Column:
        return F.struct(
            *[x[of][f].alias(f) for f in fields], x[answers]["text"].alias("raw_output"),
            *[x[answers][f].alias(f) for f in _CALL], x["outcomes"].alias("outcome"))
    outcomes = graded_all(F.transform(answers, lambda a: a["text"]), F.col("answer"), F.col("type"))
    return F.transform(F.arrays_zip(of, answers, outcomes.alias("outcomes")), one)


def _of(rows: str, outcome: str) -> Column:
    return F.filter(rows, lambda x: x["outcome"] == outcome)


def _checked(x: Column) -> Column:
    """A tried rewrite with what :func:`promptmill.operators.refine.check_candidates` adds."""
    same = F.filter("tried", lambda y: y["new_prompt"] == x["new_prompt"])
    verified = F.exists(same, lambda y: y["outcome"] == CORRECT)
    last_wrong = F.try_element_at(F.filter(same, lambda y: y["outcome"] == WRONG), F.lit(-1))["raw_output"]
    return x.withField("verified", verified).withField("model_output", F.coalesce(
        last_wrong, F.when(verified, refine.OUTPUT_IF_VERIFIED).otherwise(refine.OUTPUT_IF_MISSING)))


def _improving(score: Callable[[Column], Column], better: Callable[[Column], Column], settings: Settings) -> list[Step]:
    """Columns that say of an item in one row what ``plans.steps.improve`` says of many: ``graded``, ``candidates``, ``status``, ``rule_text``."""
    cases = F.array_join(F.transform("wrong", lambda x: tp.case_text(x["prompt"], tx.snippet(x["raw_output"]))), "\n")
    size = F.least(F.size("wrong"), F.size("rewrites"))
    # Of as many wrong prompts as there are rewrites, in order.
    pairs = F.transform(F.arrays_zip(F.slice("wrong", 1, size).alias("old"), F.slice("rewrites", 1, size).alias("new")), lambda x, i: F.struct(
        i.alias("pair_pos"), x["old"]["prompt"].alias("old_prompt"), x["new"].alias("new_prompt")))
    block = F.array_join(F.transform("verified", lambda x: tp.pair_text(x["old_prompt"], x["new_prompt"])), "\n")
    n_correct, n_wrong, n_verified = (F.size(c).cast("long") for c in ("right", "wrong", "verified"))
    status = refine.status_of(n_correct, n_wrong, F.size("candidates"), n_verified, settings.compat)
    return [
        {"answers": score(_scored("pool", "prompt"))},
        {"graded": _with_outcomes("pool", ("prompt_pos", "prompt"), "answers")},
        {"right": _of("graded", CORRECT), "wrong": _of("graded", WRONG), "correct_list": F.concat(F.lit("["), F.array_join(
            F.transform(_of("graded", CORRECT), lambda x: tx.python_repr(x["prompt"])), ", "), F.lit("]"))},
        {"proposed": better(_asked_if(
            F.size("wrong") > 0,
            tp.fill(F.lit(settings.rewrite_template), {tp.COUNT: F.size("wrong").cast("string")}),
            tp.rewrite_message(F.col("question"), F.col("answer"), cases, F.col("correct_list"))))},
        *tx.tag_blocks_steps(_text("proposed"), "REWRITE", "rewrites"),
        {"pairs": pairs},
        {"tried_answers": score(_scored("pairs", "new_prompt"))},
        {"tried": _with_outcomes("pairs", ("pair_pos", "old_prompt", "new_prompt"), "tried_answers")},
        {"candidates": F.transform("tried", _checked)},
        {"verified": F.filter("candidates", lambda x: x["verified"])},
        {"ruled": better(_asked_if(
            F.size("verified") > 0, tp.fill(F.lit(settings.rule_template), {tp.PAIRS: block}), tp.rule_message(F.col("correct_list"))))},
        {"rule_text": F.when(F.length(_text("ruled")) > 0, _text("ruled")),
         "status": F.struct(status.alias("status"), n_wrong.alias("initial_wrong"), n_verified.alias("verified_success"),
                            refine.note_of(status).alias("note"))},
    ]


def _chunking(better: Callable[[Column], Column], settings: Settings) -> list[Step]:
    """Columns of a run's row, beside what its items' rows say, from its rules to its next pool."""
    count = settings.iterative_prompts
    is_run, before = F.col("is_run"), F.col("before")
    rules_of = F.when(is_run & F.col("last").isNotNull(), F.concat(
        before["waiting"], F.transform(F.slice("new_rules", 1, F.col("room")), lambda x: F.struct(x["item_id"], x["rule_text"]))))
    text = F.array_join(F.transform("chunk_rules", lambda x, i: tp.numbered_rule(i + 1, x["rule_text"])), "\n\n")
    made = F.transform(tx.generated_prompts(_text("generated"), count), lambda x, i: F.struct(
        i.alias("prompt_pos"), x.alias("prompt")))
    return [
        {"chunk_rules": rules_of},
        {"merged_answers": better(_asked_if(
            F.col("chunk_rules").isNotNull(), tp.fill(F.lit(settings.merge_template), {tp.RULES: text}), F.lit(tp.MERGE_MESSAGE)))},
        {"merged": F.when(F.col("chunk_rules").isNotNull(), F.coalesce(_text("merged_answers"), F.lit("")))},
        {"generated": better(_asked_if(
            F.length("merged") > 0,
            tp.fill(F.lit(settings.generate_template), {tp.COUNT: F.lit(str(count)), tp.RULES: F.col("merged")}),
            F.lit(tp.generate_message(count))))},
        # A run whose rule gave no prompt keeps its pool.
        {"made": F.nullif(made, F.array().cast("array<struct<prompt_pos int, prompt string>>"))},
    ]


def _handed_on(size: int, block: int) -> list[Column]:
    """What a round writes."""
    is_run, before, made, last = (F.col(c) for c in ("is_run", "before", "made", "last"))
    filled = F.col("merged").isNotNull()
    ends = F.least(before["next"] + before["width"], before["n_items"])
    # A block has the items of two chunks of the run so far, as a round whose chunk does not fill is one more; it doubles then.
    n_played = before["n_earlier"] + last["ordinal"] + 1
    width = F.when(filled, F.greatest(F.lit(block), (n_played * 2 / (before["n_chunks"] + 1)).cast("long"))).when(
        before["next"] < before["n_items"], before["width"] * 2).otherwise(before["width"])
    # Rules after the item that filled the chunk are made again under the new pool.
    waiting = F.when(filled, F.slice(before["waiting"], 1, 0)).otherwise(F.concat(before["waiting"], F.transform(
        "new_rules", lambda x: F.struct(x["item_id"].alias("item_id"), x["rule_text"].alias("rule_text")))))
    came = F.when(before["is_new"], _pool_from(before["pool"], F.lit(0).cast("long"))).otherwise(_none_from())
    came = F.concat(came, F.coalesce(_pool_from(made, last["item_id"] + 1), _none_from()))
    return [
        is_run, *[F.col(c) for c in (*ITEM, "item", "graded", "candidates", "status", "rule_text")],
        F.when(is_run, F.struct(
            F.when(filled, last["ordinal"] + 1).otherwise(ends).alias("next"), before["n_items"].alias("n_items"),
            F.least(width, F.lit(max(MOST, block))).cast("long").alias("width"), before["n_earlier"].alias("n_earlier"),
            (before["n_chunks"] + filled.cast("long")).alias("n_chunks"), F.coalesce(made, before["pool"]).alias("pool"),
            waiting.alias("waiting"), F.lit(False).alias("is_new"), F.lit(1).cast("long").alias("n_rounds"))).alias("state"),
        F.when(is_run & filled, F.struct(
            before["n_chunks"].alias("chunk"), F.lit(size).cast("long").alias("n_rules"), last["item_id"].alias("sample_idx"),
            F.lit(False).alias("is_tail"), F.col("merged").alias("rule_text"))).alias("tier1"),
        F.when(is_run, came).alias("pools")]


def _round_of(numbered: DataFrame, models: Models, settings: Settings, block: int) -> Callable[[DataFrame, DataFrame, int, int], DataFrame]:
    """A function from a part of ``numbered``, the state before, and how many items and runs are due, to the rows of a round: every item that counts, and every run.

    A run's items count up to the one that fills its first chunk. Columns are made once for all rounds.
    """
    size = settings.group_size
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    score, better = (list_completer(m, settings.max_tries, settings.retry_delay) for m in (models.scorer, models.optimizer))
    improving, chunking, handed_on = _improving(score, better, settings), _chunking(better, settings), _handed_on(size, block)
    fields = [c for c in numbered.columns if c != "part"]
    at = [F.col("run_id").alias("_run"), F.col("state")["next"].alias("_next"), F.col("state")["width"].alias("_width"),
          F.col("state")["pool"].alias("pool")]
    due = (F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("ordinal") >= F.col("_next"))
           & (F.col("ordinal") < F.col("_next") + F.col("_width")))
    as_items = [F.lit(False).alias("is_run"), *[F.col(c) for c in (*ITEM, "ordinal")],
                F.struct(*[c for c in fields if c not in (*ITEM, "question", "ordinal")]).alias("item"),
                *[F.col(c) for c in ("graded", "candidates", "status", "rule_text")]]
    run = Window.partitionBy("run_id")
    meeting: Step = {
        "before": F.first("state", ignorenulls=True).over(run),
        "new_rules": F.array_sort(F.collect_list(
            F.when(F.col("rule_text").isNotNull(), F.struct("ordinal", "item_id", "rule_text"))).over(run))}
    room: Step = {"room": F.lit(size) - F.size("before.waiting")}
    last: Step = {"last": F.get("new_rules", F.col("room") - 1)}
    counts = F.col("is_run") | F.col("last").isNull() | (F.col("ordinal") <= F.col("last.ordinal"))

    def with_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
        for step in steps:
            df = df.withColumns(step)
        return df

    def tasks_of(n: int, of_task: int) -> int:
        return settings.partitions or min(cores, -(-n // of_task))

    def play(part: DataFrame, state: DataFrame, n_items: int, n_runs: int) -> DataFrame:
        todo = part.join(state.select(*at), due).select(*fields, "pool")
        tasks = tasks_of(n_items, TASK_ITEMS)
        items = with_steps(todo.repartition(tasks, *ITEM) if tasks > 1 else todo.coalesce(1), improving).select(*as_items)
        # A block of a run is some chunks' items, MOST at most.
        both = items.unionByName(state, allowMissingColumns=True).repartition(tasks_of(n_runs, TASK_RUNS), "run_id")
        met = with_steps(both, [meeting, room, last]).where(counts)
        return with_steps(met, chunking).select(*handed_on)
    return play


_AT_WORK = "state.next < state.n_items"
#: Runs of which a round would be one task.
_NARROW = f"{_AT_WORK} and state.width <= {TASK_ITEMS}"


def _due(which: str, most: Column, name: str) -> list[Column]:
    """Between which ordinals the next items of some runs lie, ``most`` a run, how many they are, and how many runs have any."""
    end = F.least(F.col("state.next") + most, F.col("state.n_items"))
    return [f(F.when(F.expr(which), c)).alias(f"{name}_{of}") for f, c, of in (
        (F.min, F.col("state.next"), "low"), (F.max, end, "high"), (F.sum, end - F.col("state.next"), "items"), (F.count, F.lit(1), "runs"))]


def _stretch_of(numbered: DataFrame, models: Models, settings: Settings, block: int, rows: T.StructType) -> Callable[[DataFrame, DataFrame, int, int], DataFrame]:
    """A function from a part of ``numbered``, the state before, and how many runs are narrow and there, to the rows of a stretch of the narrow ones.

    Runs stay in one task each. ``rows`` is the schema of a round, which a stretch has too.
    """
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    play, schema = player(models, settings, block, MOST, TASK_ITEMS, rows)
    own = [c for c in numbered.columns if c not in (*ITEM, "question", "ordinal", "part")]
    due = (F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("ordinal") >= F.col("_next")) & (F.col("ordinal") < F.col("_next") + MOST))

    def go_on(part: DataFrame, state: DataFrame, n_narrow: int, n_runs: int) -> DataFrame:
        # Narrow runs come first, so that as many tasks as there are have one each.
        order = Window.partitionBy("is_run").orderBy(F.when(F.expr(_NARROW), 0).otherwise(1), "run_id")
        lane = F.row_number().over(order) if n_runs <= NUMBERED_RUNS else F.hash("run_id")
        laned = state.withColumn("lane", lane)
        at = laned.where(_NARROW).select(F.col("run_id").alias("_run"), F.col("state.next").alias("_next"), "lane")
        todo = part.join(at, due).select(
            F.lit(False).alias("is_run"), *ITEM, "ordinal", "question", "answer", "type", F.struct(*own).alias("item"), "lane")
        tasks = settings.partitions or min(n_narrow, 4 * cores)
        both = todo.unionByName(laned, allowMissingColumns=True).repartitionById(tasks, F.pmod("lane", F.lit(tasks)))
        # A run's state comes before its items.
        return both.sortWithinPartitions("run_id", F.desc("is_run"), "ordinal").drop("lane").mapInArrow(play, schema)
    return go_on


def _pool_from(pool: Column, valid_from: Column) -> Column:
    return F.transform(pool, lambda p: F.struct(
        valid_from.alias("valid_from"), p["prompt_pos"].alias("prompt_pos"), p["prompt"].alias("prompt")))


def _none_from() -> Column:
    return F.array().cast("array<struct<valid_from long, prompt_pos int, prompt string>>")


def play_exactly(items: DataFrame, prompts: list[str] | tuple[str, ...], models: Models, settings: Settings,
                 base: str, n: int, block: int) -> int:
    """Play rounds after round ``n`` of the job in ``base`` until ``items`` are used up; returns the last round's number.

    A job's rows have the number of the first round that it played.
    """
    spark = items.sparkSession
    # What is played again may be cut into jobs at other rounds.
    for number in _numbers(spark, base):
        if number > n:
            deleted(spark, f"{base}/{_TABLE}/round={number}")
    rules.size_ok(settings.group_size)
    # Numbered once and stored by place, so that a round reads only its part.
    numbered = with_ordinal(items, ["run_id"], "item_id").withColumn("part", F.floor(F.col("ordinal") / PART))
    place = fresh_folder(spark, "numbered")
    numbered.repartitionByRange("part", "run_id").sortWithinPartitions("part", "run_id", "ordinal") \
        .write.partitionBy("part").parquet(place)
    numbered = spark.read.schema(numbered.schema).parquet(place)

    seeds = F.array(*[F.struct(F.lit(i).alias("prompt_pos"), F.lit(p).alias("prompt")) for i, p in enumerate(prompts)])
    before = _state(spark, base, n).select("run_id", "state.*").withColumns(
        {"n_items": F.lit(0).cast("long"), "n_earlier": F.col("n_earlier") + F.col("next")})
    known = before.unionByName(numbered.groupBy("run_id").agg(F.count("*").alias("n_items")), allowMissingColumns=True)
    began = known.groupBy("run_id").agg(F.struct(
        F.lit(0).cast("long").alias("next"), F.max("n_items").alias("n_items"),
        F.coalesce(F.max("width"), F.lit(block)).cast("long").alias("width"), F.coalesce(F.max("n_earlier"), F.lit(0)).cast("long").alias("n_earlier"),
        F.coalesce(F.max("n_chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.first("pool", ignorenulls=True), seeds).alias("pool"),
        F.coalesce(F.first("waiting", ignorenulls=True), F.array().cast("array<struct<item_id long, rule_text string>>")).alias("waiting"),
        F.coalesce(F.min("is_new"), F.lit(True)).alias("is_new"), F.lit(0).cast("long").alias("n_rounds")).alias("state"))
    state = written(began.select(F.lit(True).alias("is_run"), "run_id", "state"), "state")

    told_of = [*_due(_AT_WORK, F.col("state.width"), "any"), *_due(_NARROW, F.lit(MOST), "narrow"),
               F.count("state").alias("runs"), F.max("state.n_rounds").alias("rounds")]
    told = state.agg(*told_of).first().asDict()
    play = _round_of(numbered, models, settings, block)
    go_on = _stretch_of(numbered, models, settings, block, play(numbered, state, 1, 1).schema)
    while told["any_runs"]:
        # What is asked for more calls in flight than there are runs is played by rounds, which deal a run's items to tasks.
        in_one = told["narrow_runs"] > 0 and (settings.partitions or 0) <= told["narrow_runs"]
        low, high = (told[f"{'narrow' if in_one else 'any'}_{end}"] for end in ("low", "high"))
        part = numbered.where(F.col("part").between(low // PART, (high - 1) // PART))
        rows = go_on(part, state, told["narrow_runs"], told["runs"]) if in_one else play(part, state, told["any_items"], told["runs"])
        seen = Observation("round")
        rows.observe(seen, *told_of).write.mode("overwrite").parquet(f"{base}/{_TABLE}/round={n + 1}")
        told = seen.get
        state = _state(spark, base, n + 1)
        n += told["rounds"]
    return n
