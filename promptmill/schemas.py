"""Fixed schemas of every table and file the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_CHOICE_ITEM = T.StructType([
    T.StructField("subset", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("answer", T.IntegerType()),
])

RAW_MATH_ITEM = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

ITEM = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
])

POOL = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("valid_from", T.LongType()),
    T.StructField("prompt_pos", T.IntegerType()),
    T.StructField("prompt", T.StringType()),
])

#: One row a model call; ``step``, ``round`` and ``level`` say which part of a job asked.
USAGE = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
])

# File layouts: field names, order and types as the files carry them.
DETAILED_RESULT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("q", T.StringType()),
    T.StructField("res", T.MapType(T.StringType(), T.BooleanType())),
])

REFINEMENT_TRACE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("original_prompt", T.StringType()),
    T.StructField("candidate_prompt", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("model_output", T.StringType()),
])

PROMPT_HISTORY = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("prompts", T.ArrayType(T.StringType())),
    T.StructField("derived_from_rule_tier", T.StringType()),
    T.StructField("count", T.IntegerType()),
])

RULE_EVOLUTION = T.StructType([
    T.StructField("sample_idx", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("rule_content", T.StringType()),
])

STATUS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("initial_wrong", T.LongType()),
    T.StructField("verified_success", T.LongType()),
    T.StructField("note", T.StringType()),
])

COST = T.StructType([
    T.StructField("Timestamp", T.StringType()),
    T.StructField("Role", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Input Tokens", T.LongType()),
    T.StructField("Output Tokens", T.LongType()),
    T.StructField("Total Tokens", T.LongType()),
    T.StructField("Est. Cost ($)", T.DecimalType(18, 5)),
])
