"""Stored run folders: finding them, their prompt files and the reports written about them.

A run folder is a folder whose name ends in the time the run started; it may stand at any depth, and as a partition
(``run=<name>``). Its files are known by the part of the path after it. Listing is Spark's own, so it is
dealt over the executors where there are many folders, and no file is opened to be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions import text as tx
from promptmill.functions.names import run_parts
from promptmill.operators import reports as rp

_FOLDER = r"/(?:[^/=]+=)?([^/=]+_\d{8}-\d{6})/"
_REPORT = r"/(?:[^/=]+=)?([^/=]+_\d{8}-\d{6})_([^/=_]+)_eval(?:\.txt)?(?:/[^/]*)?$"
_PROMPTS = r"_\d{8}-\d{6}/(?:[^/=]+=)?optimized_prompts(?:\.txt)?(?:/[^/]*)?$"


def run_name_in(path: Column) -> Column:
    """Name of the run folder that a path goes through; null if none."""
    return F.nullif(F.regexp_extract(path, _FOLDER, 1), F.lit(""))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """``run_name``, ``path``, ``bytes``, ``modified`` of every file in a run folder below ``root``."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return listed.select(run_name_in(F.col("path")).alias("run_name"), "path", F.col("length").alias("bytes"),
                         F.col("modificationTime").alias("modified")).where("run_name is not null")


def _texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    # A filter on the file's path takes files out before any is read.
    return (spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
            .where(F.rlike(F.col("_metadata.file_path"), F.lit(pattern))).select(F.col("_metadata.file_path").alias("path"), "value"))


def stored_prompts(spark: SparkSession, root: str) -> DataFrame:
    """``run_name``, ``prompt_pos``, ``prompt`` of every saved prompt file; a file without a prompt gives no row."""
    return _texts(spark, root, _PROMPTS).select(
        run_name_in(F.col("path")).alias("run_name"),
        F.posexplode(tx.prompt_lines(F.col("value"))).alias("prompt_pos", "prompt"))


def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder: ``run_name``, the pieces of its name, ``n_files``, ``bytes``, ``n_prompts``.

    ``n_prompts`` is 0 where the prompt file holds none, and null where there is no such file.
    """
    files = stored_files(spark, root).groupBy("run_name").agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"),
        F.max(F.rlike(F.col("path"), F.lit(_PROMPTS))).alias("_file"))
    held = stored_prompts(spark, root).groupBy("run_name").agg(F.count("*").alias("n_prompts"))
    return files.join(held, "run_name", "left").select(
        "run_name", *run_parts(F.col("run_name")), "n_files", "bytes",
        F.when(F.col("_file"), F.coalesce("n_prompts", F.lit(0))).alias("n_prompts"))


def stored_reports(spark: SparkSession, root: str) -> DataFrame:
    """Results in the reports below ``root``: ``run_name``, ``split``, ``prompt_no``, ``percent``, ``correct``, ``total``, ``label``."""
    found = rp.parsed_reports(_texts(spark, root, _REPORT).select(
        "path", F.explode(F.split("value", rp.RULE + "\n")).alias("value")))
    return found.select(F.regexp_extract("path", _REPORT, 1).alias("run_name"), F.regexp_extract("path", _REPORT, 2).alias("split"),
                        *(c for c in found.columns if c != "path"))


def evaluated_prompts(spark: SparkSession, runs_root: str, reports_root: str) -> DataFrame:
    """Every prompt of every stored run with its result in each report on that run.

    ``correct``, ``total`` and ``split`` are null for a prompt that no report tells of. The report's name begins with the name of the
    run's folder; reports under other names are matched with :func:`promptmill.operators.reports.with_nearest_run`.
    """
    prompts = stored_prompts(spark, runs_root).withColumn("prompt_no", F.col("prompt_pos") + 1)
    told = stored_reports(spark, reports_root).select("run_name", "prompt_no", "split", "correct", "total")
    return prompts.join(told, ["run_name", "prompt_no"], "left").select(
        "run_name", "prompt_no", "prompt", "split", "correct", "total")
