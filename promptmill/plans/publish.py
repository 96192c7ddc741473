"""Runs that readers see whole: tables are staged beside the published ones, and one step publishes all of them.

Below the folder every table keeps one subfolder per version, and numbered manifests say which version
holds which run (one row a run). A writer stages its version, then writes the next manifest and gives it its number
by a rename. Readers follow the last manifest: until the rename they see the old runs, after it the new ones.
Nothing is cleared when a run is replaced; :func:`vacuum` deletes versions that hold no published run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill import schemas
from promptmill.functions import text as tx
from promptmill.plans.files import TABLES, write_tables
from promptmill.plans.improvement import Run
from promptmill.sources.results import RUN
from promptmill.workspace import claimed, deleted, finished, folders

#: How often a writer that others overtake begins its manifest anew.
ATTEMPTS = 20
_MANIFEST, _VERSION = "manifest-", "version"
_SCHEMA = T.StructType([T.StructField(RUN, T.LongType()), T.StructField(_VERSION, T.StringType())])
_JSON = {"detailed_results": schemas.DETAILED_RESULT, "refinement_trace": schemas.REFINEMENT_TRACE,
         "prompt_history": schemas.PROMPT_HISTORY, "rule_evolution": schemas.RULE_EVOLUTION}
_CSV = {"optimization_status": schemas.STATUS, "cost_report": schemas.COST}


def stage_run(run: Run, items: DataFrame, folder: str, usage: DataFrame | None = None,
              models: dict[str, str] | None = None, detail_size: int | None = 10) -> str:
    """Write the tables of the runs as a version that nobody reads yet; its name."""
    version = f"v{uuid.uuid4().hex}"
    write_tables(run, items, lambda table: f"{folder}/tables/{table}/{_VERSION}={version}", usage, models, detail_size)
    return version


def publish(runs: DataFrame, folder: str, version: str) -> int:
    """Let readers find the runs in ``runs`` in ``version`` from now on; the number of the manifest that says so.

    All of them in one step. Another writer may publish meanwhile: then its manifest is what this one builds on.
    """
    spark = runs.sparkSession
    own = runs.select(F.col(RUN).cast("long").alias(RUN)).distinct()
    for _ in range(ATTEMPTS):
        last = _last(spark, folder)
        others = manifest(spark, folder, last).alias("m").join(own.alias("o"), F.expr(f"m.{RUN} <=> o.{RUN}"), "left_anti")
        staged = f"{folder}/_staged-{uuid.uuid4().hex}"
        others.unionByName(own.withColumn(_VERSION, F.lit(version))).write.parquet(staged)
        if claimed(spark, staged, f"{folder}/manifests/{_MANIFEST}{last + 1}"):
            return last + 1
        deleted(spark, staged)
    raise RuntimeError(f"{ATTEMPTS} times another writer published to {folder} first")


def publish_run(run: Run, items: DataFrame, folder: str, usage: DataFrame | None = None,
                models: dict[str, str] | None = None, detail_size: int | None = 10) -> str:
    """Stage and publish the runs of ``items``; other published runs stay as they are."""
    version = stage_run(run, items, folder, usage, models, detail_size)
    publish(items, folder, version)
    return version


def _last(spark: SparkSession, folder: str) -> int:
    return max((int(n.removeprefix(_MANIFEST)) for n in finished(spark, f"{folder}/manifests")), default=-1)


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """(run_id, version) of every published run, one row a run; empty before the first publication."""
    number = _last(spark, folder) if number is None else number
    if number < 0:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(f"{folder}/manifests/{_MANIFEST}{number}")


def _versions(live: DataFrame) -> set[str]:
    """Versions in use: at most one a publication, whatever the number of runs."""
    return {r[0] for r in live.select(_VERSION).distinct().collect()}


def _written(spark: SparkSession, folder: str, table: str) -> list[str]:
    return [n.partition("=")[2] for n in folders(spark, f"{folder}/tables/{table}") if n.startswith(f"{_VERSION}=")]


def published(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The rows of one of ``TABLES`` for every published run; ``None`` where no version has that table.

    Only versions in use are listed and read. Texts come as ``value``, prompts line by line (``prompt_pos``, ``prompt``).
    All tables of one reading should go by one manifest: publications in between show in later calls only.
    """
    live = manifest(spark, folder)
    root, versions = f"{folder}/tables/{table}", _versions(live)
    paths = [f"{root}/{_VERSION}={v}" for v in sorted(versions.intersection(_written(spark, folder, table)))]
    if not paths:
        return None
    reader = spark.read.option("basePath", root)
    own = [T.StructField(_VERSION, T.StringType()), T.StructField(RUN, T.LongType())]
    if table in _JSON:
        rows = reader.schema(T.StructType([*_JSON[table].fields, *own])).json(paths)
    elif table in _CSV:
        rows = reader.schema(T.StructType([*_CSV[table].fields, *own])).option("header", True).csv(paths)
    else:
        text = T.StructType([T.StructField("value", T.StringType()), *own])
        rows = reader.schema(text).text(paths, wholetext=True)
    rows = rows.alias("r").join(live.alias("m"), F.expr(f"r.{_VERSION} = m.{_VERSION} and r.{RUN} <=> m.{RUN}"), "left_semi")
    if table == "optimized_prompts":
        rows = rows.select("*", F.posexplode(tx.prompt_lines(F.col("value"))).alias("prompt_pos", "prompt")).drop("value")
    if table == "optimization_status":
        rows = rows.withColumn("note", F.coalesce("note", F.lit("")))
    return rows.drop(_VERSION)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete versions that hold no published run, and all manifests but the last; the number of versions deleted.

    Not while a writer is between staging and publishing, or a reader follows an older manifest.
    """
    last = _last(spark, folder)
    used = _versions(manifest(spark, folder, last))
    gone = set()
    for table in TABLES:
        for version in set(_written(spark, folder, table)) - used:
            deleted(spark, f"{folder}/tables/{table}/{_VERSION}={version}")
            gone.add(version)
    for name in finished(spark, f"{folder}/manifests"):
        if int(name.removeprefix(_MANIFEST)) < last:
            deleted(spark, f"{folder}/manifests/{name}")
    return len(gone)
