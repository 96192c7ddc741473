"""Result files of runs: JSON lines, CSV tables, prompt files, rule logs and reports.

Every table is partitioned by run. Schemas are fixed: inference would make one field per
prompt text out of a result map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill import schemas
from promptmill.functions import text as tx
from promptmill.operators import reports
from promptmill.operators.ordered import ordinal_over_buckets

RUN = "run_id"


def _with_run(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RUN, T.LongType())])


def _writer(df: DataFrame, restart: bool, spread: bool = True):
    """Append, or replace just the runs that are written.

    Rows are rebalanced by run first: a run gets files of a good size and not one from every
    task, and a run that holds much of the rows is split over many tasks.
    """
    df = df.hint("rebalance", RUN) if spread else df
    if restart:
        return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN)
    return df.write.mode("append").partitionBy(RUN)


def clear_runs(path: str, runs: DataFrame) -> None:
    """Take away what ``path`` holds of the runs in ``runs``: the start of these runs, also of one that leaves no row.

    Run ids come to the driver one part of the table at a time.
    """
    spark = runs.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in runs.select(F.col(RUN)).distinct().toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else row[0]
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{RUN}={name}"), True)


def write_json(df: DataFrame, path: str, restart: bool = False) -> None:
    _writer(df, restart).json(path)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(_with_run(schema)).json(path)


def write_csv(df: DataFrame, path: str, restart: bool = False) -> None:
    _writer(df, restart).option("header", True).option("emptyValue", "").csv(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_with_run(schemas.STATUS)).option("header", True).csv(path)
    return rows.withColumn("note", F.coalesce("note", F.lit("")))


def read_cost(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_run(schemas.COST)).option("header", True).csv(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Calls of all steps, rounds and levels that a job left below its ``usage_folder``."""
    return spark.read.schema(schemas.USAGE).option("recursiveFileLookup", True).parquet(path)


def cost_rows(report: DataFrame) -> DataFrame:
    """A cost report (with ``ended``, ``role``, ``model``) in the layout of the cost file."""
    return report.select(
        F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("role").alias("Role"),
        F.col("model").alias("Model"), F.col("input_tokens").alias("Input Tokens"),
        F.col("output_tokens").alias("Output Tokens"), F.col("total_tokens").alias("Total Tokens"),
        F.col("est_cost").alias("Est. Cost ($)"), RUN)


# Prompt files: one prompt per line, in order.

def write_prompts(pools: DataFrame, path: str) -> None:
    """One small file per run: the prompts of a run are one row before they are written."""
    packed = pools.groupBy(RUN).agg(
        F.expr(r"listagg(prompt, '\n') within group (order by prompt_pos)").alias("value"))
    _writer(packed, restart=True, spread=False).text(path)


def write_final_rules(rules: DataFrame, path: str) -> None:
    """The final rule of every run as a text file of its own."""
    _writer(rules.select(F.col("rule_text").alias("value"), RUN), restart=True, spread=False).text(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of saved prompt files (``path``, ``prompt_pos``, ``prompt``)."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return whole.select("*", F.posexplode(tx.prompt_lines(F.col("value"))).alias("prompt_pos", "prompt")).drop("value")


# Rule logs: titled blocks.

_BLOCK = "\n========== "


def rule_block(title, body):
    """A titled block as the log file carries it."""
    return F.concat(F.lit("\n" + "=" * 10 + " "), title, F.lit(" " + "=" * 10 + "\n"), body)


def write_rule_log(blocks: DataFrame, path: str, restart: bool = True) -> None:
    """``blocks`` has ``run_id``, ``value`` (see :func:`rule_block`) and ``block_no``, which rows are sorted by.

    Rows are spread by range, so a long log becomes many files and not one task's work.
    """
    ordered = blocks.repartitionByRange(RUN, "block_no").sortWithinPartitions(RUN, "block_no")
    _writer(ordered.select("value", RUN), restart, spread=False).text(path)


def read_rule_log(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of rule logs: ``path``, ``block_pos`` within the file, ``title``, ``body``.

    The reader itself splits at block heads, so files are read in parallel pieces. A piece
    of a file keeps its rows in order, and its own position orders the pieces.
    """
    raw = spark.read.option("lineSep", _BLOCK).text(path)
    placed = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_piece"),
        F.monotonically_increasing_id().alias("_seen"), "value",
    )
    head = r"(?s)\A(?:\n========== )?(.*?) ={10}\n(.*)\z"
    blocks = placed.where(F.rlike("value", F.lit(head))).select(
        "path", "_piece", "_seen",
        F.regexp_extract("value", head, 1).alias("title"),
        F.regexp_replace(F.regexp_extract("value", head, 2), r"\n\z", "").alias("body"))
    return ordinal_over_buckets(blocks, ["path"], "_piece", ["_seen"], "block_pos").drop("_piece", "_seen")


# Evaluation reports.

def write_reports(blocks: DataFrame, path: str) -> None:
    """One file per run. A report has one block per prompt of a pool, so it is small."""
    joined = blocks.groupBy(RUN).agg(
        F.expr("listagg(text, '') within group (order by block)").alias("value"))
    # The writer ends the file with the line break taken off here.
    cut = joined.select(F.regexp_replace("value", r"\n\z", "").alias("value"), RUN)
    _writer(cut, restart=True, spread=False).text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", reports.RULE + "\n").text(path)
    return reports.parsed_reports(raw.withColumn("path", F.col("_metadata.file_path")))
