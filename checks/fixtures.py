"""Prompts, outputs, rewrites, rules and usage derived from the given tables.

The tables hold no model outputs, so these views make them from every row and the whole
text of the given ones, by rules that ``oracles`` states again as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.operators.requests import SEED_PROMPTS, ask_all
from promptmill.workspace import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents"))


def from_documents(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id as item_id", "source as subset", "cast(floor(doc_id / 10) as bigint) % 4 as run_id",
        "text as question",
        "case doc_id % 10 when 0 then 'math' when 1 then 'general' else 'multiple_choice' end as type",
        """case doc_id % 10 when 0 then cast(1000 + doc_id as string) when 1 then 'yes'
           else substring('ABCD', cast(doc_id % 4 as int) + 1, 1) end as answer""")


def raw_choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice items whose choices are the lines of a document."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("subset"), F.col("doc_id").alias("pos"), F.col("text").alias("question"),
        F.split("text", "\n").alias("choices"), (F.col("doc_id") % 6 - 1).cast("int").alias("answer"))


def raw_math_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("long").alias("pos"), F.col("text").alias("question"),
        F.concat("text", F.lit(" #### "), F.col("item_id").cast("string")).alias("answer"))


def answered(asked: DataFrame) -> DataFrame:
    """Outputs of items × prompts: right, wrong or no answer, in five manners of speech."""
    given = asked.selectExpr(
        "*",
        "(item_id % 9 = 2 or (item_id * 31 + prompt_pos * 17) % 10 < 3 + prompt_pos) as _ok",
    ).selectExpr(
        "*",
        """case when _ok then answer when type = 'math' then '7' when type = 'general' then 'no'
           else substring('BCDA', cast(item_id % 4 as int) + 1, 1) end as _given""")
    return given.selectExpr(
        "run_id", "item_id", "subset", "type", "answer", "prompt_pos", "prompt",
        r"""case when (item_id * 7 + prompt_pos) % 97 = 0 or item_id % 53 = 5 then null
            when type = 'math' then question || ' First 12, so the total is ' || _given || '.'
            when type = 'general' then chr(10) || ' ' || _given || case when _given = answer then ' ' else question end
            when item_id % 5 = 0 then question || ' The answer is (' || _given || '). Not (E).'
            when item_id % 5 = 1 then question || ' So ' || chr(92) || 'boxed{ ' || lower(_given) || ' } it is'
            when item_id % 5 = 2 then question || ' Not (E), so finally (' || _given || ')'
            when item_id % 5 = 3 then question || ' Answer: ' || _given || ' rather than E'
            else question || ' ' || _given || '.' end as raw_output""")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(ask_all(spread(items(spark, sf_dir), "item_id"), SEED_PROMPTS))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite responses: tagged, loosely tagged, untagged, with a repeated rewrite."""
    return spread(items(spark, sf_dir), "item_id").selectExpr(
        "run_id", "item_id",
        """case item_id % 4
           when 0 then '<BLOCK><THOUGHT>t</THOUGHT><REWRITE_BEGIN>' || chr(10) || 'Check ' || subset
             || '</REWRITE_END></BLOCK><REWRITE_BEGIN>Verify ' || question || '</REWRITE_END>'
           when 1 then '<REWRITE BEGIN>Loose form of ' || question || '</REWRITE END>'
           when 2 then 'No tags at all in ' || question
           else '<rewrite_begin> twice </rewrite_end><REWRITE_BEGIN>' || question || '</REWRITE_END><REWRITE_BEGIN>twice</REWRITE_END>'
           end as response""")


def candidate_outputs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Outputs of rewritten prompts on their item."""
    met = pairs.join(items.select("run_id", "item_id", "subset", "type", "answer", "question"), ["run_id", "item_id"])
    return met.selectExpr(
        "*",
        """case when (item_id + pair_pos) % 3 > 0 then answer when type = 'math' then '7'
           when type = 'general' then 'no' else substring('BCDA', cast(item_id % 4 as int) + 1, 1) end as _given""",
    ).selectExpr(
        "run_id", "item_id", "subset", "type", "answer", "pair_pos", "old_prompt", "new_prompt",
        """case when (item_id * 3 + pair_pos) % 41 = 0 then null when type = 'math' then question || ' So ' || _given
           when type = 'general' then _given || case when _given = answer then '' else question end
           else question || ' Answer: (' || _given || ')' end as raw_output""")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_conversations(table(spark, sf_dir, "conversations"))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A rule per turn, its whole text among the thinking steps and words of it in the vocabulary."""
    return conversations.selectExpr(
        "conv_id * 100 + turn as item_id", "conv_id % 4 as run_id",
        """'Certainly!' || chr(10) || '[Guiding Tone]' || chr(10) || 'Authoritative' || chr(10) || chr(10)
           || '[Key Vocabulary]' || chr(10) || 'Clarity, ' || coalesce(split(text, ' ')[0], '') || ', Term '
           || coalesce(get(split(text, ' '), 4), '') || chr(10) || chr(10) || '[Thinking Steps]' || chr(10) || '1. ' || text
           || chr(10) || chr(10) || '---' || chr(10) || 'Done.' as rule_text""")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation responses: numbered, quoted, with talk, and whole texts."""
    return items(spark, sf_dir).selectExpr(
        "run_id", "item_id",
        """case item_id % 4
           when 0 then 'Here are the prompts:' || chr(10) || '1. Think about ' || subset || ' first' || chr(10)
             || 'short' || chr(10) || '2) Check each step twice' || chr(10) || question
           when 1 then '"Verify the final result"' || chr(10) || chr(10) || '''Explain every decision''' || chr(10) || question
           when 2 then question
           else '  Analyze the data. Then answer  ' || question end as response""")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as call_id", "ts", "user_id % 4 as run_id",
        "case when event_type in ('view', 'click') then 'scorer' else 'optimizer' end as role",
        "case when event_type in ('view', 'click') then 'small:7b' else 'large:32b' end as model",
        "cast(floor(value * 10) as bigint) as prompt_tokens",
        "cast(floor(value * 25) as bigint) as completion_tokens")
