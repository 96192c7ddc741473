"""The model call between a request table and a response table."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from promptmill.workspace import deleted, dropped, fresh_folder, shuffles_dropped, written

# Sent to executors as code, so that the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ``(system, user)`` to a text, or to a text with prompt and completion tokens.
Model = Callable[[str, str], "str | tuple[str, int, int]"]


def ask(call: Model, system: str, user: str, max_tries: int, retry_delay: float, strip: bool) -> tuple:
    """(text, tries, error, prompt tokens, completion tokens) of one request, tried until it is answered."""
    error = None
    for attempt in range(1, max_tries + 1):
        try:
            answer = call(system, user)
            text, used, made = answer if isinstance(answer, tuple) else (answer, None, None)
            return text.strip() if strip else text, attempt, None, used, made
        except Exception as raised:  # a model may fail in any way
            error = f"{type(raised).__name__}: {raised}"
            if attempt < max_tries:
                time.sleep(retry_delay)
    return None, max_tries, error, None, None


def complete(requests: DataFrame, model: Callable[[], Model], max_tries: int = 3, retry_delay: float = 1.0,
             out: str = "raw_output", partitions: int | None = None, strip: bool = True,
             asked_at: str | None = None) -> DataFrame:
    """Ask the model every request; ``system`` and ``user`` become ``out`` and call columns.

    ``model`` builds the callable once per partition, on the executor, so that a client
    need not be sent there. A call that raises is tried again up to ``max_tries`` times; a
    request that keeps failing stays as a row with a null ``out`` and its last ``error``.
    ``partitions`` bounds how many calls are in flight across the cluster, one a core that Spark gives the job at most.
    ``asked_at`` names a column for the time of each answer.

    Answers of a real model differ from call to call: write the result before using it twice.
    """
    kept = [f for f in requests.schema.fields if f.name not in ("system", "user")]
    schema = T.StructType(kept + [
        T.StructField(out, T.StringType()),
        T.StructField("tries", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
    ] + ([T.StructField(asked_at, T.TimestampType())] if asked_at else []))
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for batch in batches:
            times, rows = [], []
            for system, user in zip(batch["system"], batch["user"]):
                rows.append(ask(call, system, user, max_tries, retry_delay, strip))
                times.append(pd.Timestamp.now("UTC"))
            got = pd.DataFrame(rows, columns=[out, "tries", "error", "prompt_tokens", "completion_tokens"],
                               index=batch.index)
            got = got.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            if asked_at:
                got[asked_at] = pd.Series(times, index=batch.index, dtype="datetime64[us, UTC]")
            yield pd.concat([batch[names], got], axis=1)

    asked = requests if partitions is None else requests.repartition(partitions)
    return asked.mapInPandas(run, schema)


#: An answer in a list of them, as :func:`ask` gives it.
ANSWER = "text string, tries int, error string, prompt_tokens long, completion_tokens long"


def list_completer(model: Callable[[], Model], max_tries: int = 3, retry_delay: float = 1.0,
                   strip: bool = True) -> Callable[[str], Column]:
    """A function from a column of lists of requests (``system``, ``user``) to one of the lists of their answers.

    Rows stay in their task, so that what an answer leads to can be asked in the same job. The model is built once per
    partition, as in :func:`complete`.
    """
    answers = T.ArrayType(T.StructType.fromDDL(ANSWER))
    names, kind = answers.elementType.fieldNames(), to_arrow_type(answers)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = model()
        for batch in batches:
            yield pa.array([
                [dict(zip(names, ask(call, r["system"], r["user"], max_tries, retry_delay, strip))) for r in asked or ()]
                for asked in batch.to_pylist()], kind)

    # Answers differ from call to call, so Spark must neither ask twice nor move the call.
    return F.arrow_udf(run, answers).asNondeterministic()


#: Names a request in a store of answers, from its keys and its whole text; and when it was answered.
REQUEST, ASKED_AT = "request_id", "asked_at"


def request_id(keys: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*keys, "system", "user"), {"ignoreNullFields": "false"}), 256)


#: Calls of a task of a cut job, if a piece has as many, and the most tasks of one job (``CORE_TASKS`` a core if that is more):
#: the texts that a job moves lie on disk until it is done.
TASK_CALLS, JOB_TASKS, CORE_TASKS = 1_000, 1_000, 16
#: Parts that a task's share of requests is dealt in. Requests that lie side by side stay so: they often hold the same text.
TASK_SLOTS = 16


def complete_once(requests: DataFrame, model: Callable[[], Model], store: str, keys: list[str], piece_calls: int = 100_000,
                  out: str = "raw_output", **how) -> DataFrame:
    """Ask only what ``store`` holds no answer to yet, and give the answers to all ``requests``.

    More than ``piece_calls`` open requests are dealt by their place to small tasks, and a task's answers are kept as soon as it is
    done: a lost job asks again what its tasks had in hand, some ``piece_calls`` in all (or ``TASK_CALLS`` a core, if that is
    more). Jobs do not follow the number of pieces. Requests that failed are kept as failed. ``keys`` tell requests apart; a
    request that stands twice is asked once.

    Texts are written once, as they come, and moved once, to their task. What is open is found by ids and places alone.
    """
    spark = requests.sparkSession
    named = requests.withColumn(REQUEST, request_id(keys))
    fields = [REQUEST, out, "tries", "error", "prompt_tokens", "completion_tokens", ASKED_AT]
    schema = f"{REQUEST} string, {out} string, tries int, error string, prompt_tokens long, completion_tokens long, {ASKED_AT} timestamp"
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    told = spark.read.schema(schema).parquet(store).select(REQUEST)
    lying = fresh_folder(spark, "laid_requests")
    named.select(REQUEST, "system", "user", F.monotonically_increasing_id().alias("place")).write.option("compression", "zstd").parquet(lying)
    laid = spark.read.schema(f"{REQUEST} string, system string, user string, place long").parquet(lying)
    # Of requests that stand twice the first place is open.
    first = laid.select(REQUEST, "place").join(told, REQUEST, "left_anti").groupBy(REQUEST).agg(F.min("place").alias("place"))
    open_ = written(first.select("place"), "open_places")
    different, at_once = open_.count(), how.pop("partitions", None)
    all_open = different == laid.count()
    size = min(piece_calls, max(TASK_CALLS, -(-piece_calls // (at_once or spark.sparkContext.defaultParallelism))))
    tasks, most = -(-different // size), at_once or max(JOB_TASKS, CORE_TASKS * spark.sparkContext.defaultParallelism)
    jobs = -(-tasks // most) if different > piece_calls else min(different, 1)
    of_one = at_once or -(-tasks // max(jobs, 1))
    width = max(1, size // TASK_SLOTS)
    slot = F.expr(f"place div {width}L").alias("slot")
    bounds = [None] * (jobs + 1)
    if jobs > 1:
        # A job reads its part of the places only.
        shares = [F.lit(i / jobs) for i in range(1, jobs)]
        bounds[1:-1] = [place // width * width for place in open_.agg(F.percentile_approx("place", F.array(*shares), F.lit(100 * jobs))).first()[0]]
    for low, high in zip(bounds, bounds[1:]):
        def of_job(df: DataFrame) -> DataFrame:
            df = df if low is None else df.where(F.col("place") >= low)
            return df if high is None else df.where(F.col("place") < high)
        if different > piece_calls:
            part = of_job(laid).select("*", slot).repartition(min(tasks, of_one), "slot")
            if not all_open:
                places = of_job(open_).select("place", slot).repartition(min(tasks, of_one), "slot").groupBy("slot").agg(F.collect_list("place").alias("places"))
                part = part.join(places, "slot").where(F.array_contains("places", F.col("place")))
        else:
            part = laid if all_open else laid.join(open_, "place", "left_semi")
            part = part.repartition(at_once) if at_once else part
        answers = complete(part.select(REQUEST, "system", "user"), model, out=out, asked_at=ASKED_AT, **how).select(*fields)
        # By this rule files are in their place once their task is done, not only once its job is.
        with shuffles_dropped(spark):
            answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    deleted(spark, lying)
    dropped(open_)
    return named.drop("system", "user").join(spark.read.schema(schema).parquet(store), REQUEST)


def call_usage(answers: DataFrame, role: str, model: str | None, step: str, round: int, level: int) -> DataFrame:
    """Token usage of the answered calls of a step, one row each, in the layout of ``schemas.USAGE``."""
    return usage_rows(answers, role, [REQUEST, ASKED_AT, "run_id"]).select(
        F.col(REQUEST).alias("call_id"), F.col(ASKED_AT).alias("ts"), "run_id", "role", F.lit(model).cast("string").alias("model"),
        F.lit(step).alias("step"), F.lit(round).alias("round"), F.lit(level).alias("level"), "prompt_tokens", "completion_tokens")


def usage_rows(responses: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """Token usage of answered calls, one row each."""
    return responses.where(F.col("prompt_tokens").isNotNull()).select(
        *keys, F.lit(role).alias("role"), "prompt_tokens", "completion_tokens")
