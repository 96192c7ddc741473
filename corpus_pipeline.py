"""From raw documents to an encoded training mix, stage by stage; each stage's table is written before the next reads it.

Every stage takes (spark, docs, sf_dir), docs being all rows that the stage before kept, and returns the
columns of ``documents``; the last adds what encoding gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm.bpe import digests
from promptmill.llm.jaccard import similar
from promptmill.llm.mixing import sampled
from promptmill.llm.queries import word_bpe
from promptmill.llm.substrings import without_repeats
from promptmill.llm.toxicity import THRESHOLD, fit, scored
from promptmill.workspace import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``columns`` as strings under names of their own, to go along with a decision on each row."""
    return docs.select("*", *(F.col(c).cast("string").alias(f"_{c}") for c in columns))


def _told(decided: DataFrame) -> DataFrame:
    """The columns of ``documents`` as they went along."""
    return decided.select("doc_id", "text", F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_n_chars").cast("long").alias("n_chars"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression distance finds toxic go, whatever their ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = scored(_kept(docs, ("lang", "source", "n_chars")), fit(docs, labels), keep=("text", "_lang", "_source", "_n_chars"))
    return _told(judged.where(F.col("score") < THRESHOLD))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by near duplicates, one of the least id stays (null ids come last); rows without words all stay.

    A row is known by the md5 of all it holds. Of rows of one class and id the least md5 stays, and of rows
    that agree in everything any one.
    """
    whole = F.unhex(F.md5(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).cast("binary")))
    rows = written(similar(docs, row=whole).select("doc_id", "row", "class_key"), "classes")
    first = (rows.where("class_key is not null").groupBy("class_key")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")).select("first.row"))
    copies = rows.where("class_key is not null").groupBy("row").agg(F.count("*").alias("copies"))
    wordless = rows.where("class_key is null").select("row", F.lit(1).cast("long").alias("copies")).distinct()
    stay = written(first.join(copies, "row").unionByName(wordless), "stay")
    held = docs.select(*COLUMNS, whole.alias("row")).join(stay, "row")
    single = held.where("copies = 1").select(*COLUMNS)
    if stay.where("copies > 1").isEmpty():
        return single
    one = held.where("copies > 1").groupBy("row").agg(F.first(F.struct(*COLUMNS)).alias("one")).select("one.*")
    return single.unionByName(one)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 50 that an earlier document holds are cut; texts without a repeat stay as they are."""
    cut = without_repeats(docs, keep=("lang", "source", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that rake tokens to the marginals' targets."""
    kept = _kept(docs, ("text", "lang", "source", "n_chars"))
    return _told(sampled(kept, keep=("_text", "_lang", "_source", "_n_chars")).where("taken").withColumnRenamed("_text", "text"))


def encoded_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document drawn."""
    return digests(docs, word_bpe())


STAGES = [
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_class),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", mixed_to_targets),
    ("BPE encoding and decoding", encoded_texts),
]

#: SQL cannot state the stages with models; tests/llm holds the pipeline to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
