"""Request texts for the optimizer model, and filling user templates.

Default templates are plain starting points; callers pass their own strings. The user
message layouts are fixed formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the fill-in places.
COUNT, RULES, PAIRS = "{num}", "{rules_block}", "{pairs_block}"

REWRITE_TEMPLATE = (
    "Each prompt below led a model to a wrong answer. Say briefly why, then amend the prompt so that it "
    "helps with any question of this kind. Answer with {num} blocks, one per prompt and in the same order: "
    "<BLOCK><THOUGHT>why</THOUGHT><REWRITE_BEGIN>amended prompt</REWRITE_END></BLOCK>"
)
RULE_TEMPLATE = (
    "State as one short guideline what turned these failing prompts into working ones.\n\n{pairs_block}"
)
MERGE_TEMPLATE = (
    "Merge these rules into one. Use the headings [Guiding Tone], [Key Vocabulary], [Structural Elements], "
    "[Thinking Steps], [Do's] and [Don'ts], and put first what several rules agree on.\n\n{rules_block}"
)
GENERATE_TEMPLATE = "Write {num} different prompts, one per line, that follow this rule:\n\n{rules_block}"

# Formats of what is shown to the optimizer, a place ``{}`` for each text.
CASE = "<CASE>\nOriginal Prompt: {}\nModel Output: {}\n</CASE>"
REWRITE_MESSAGE = (
    "[TASK CONTEXT]\nQuestion: {}\nGround Truth: {}\n\n[FAILED PROMPTS & OUTPUTS]\n{}\n\n[SUCCESSFUL PROMPTS (REFERENCE)]\n{}"
)
PAIR = "Original: {}\nImproved: {}"
RULE_MESSAGE = "Correct Prompts:\n{}"
NUMBERED_RULE = "Rule {}:\n{}"

# User messages of the merge and generation requests.
MERGE_MESSAGE = "Please fill the template based on the rules above."


def generate_message(count: int) -> str:
    return f"Please generate {count} new prompts based on the above rule now."


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Put values into a template, those given first going in first.

    Replacement is literal: braces elsewhere in the template are plain text, and nothing
    can fail to format. Give the value that comes from a model last, so that a place's
    name inside it stays as it is.
    """
    for place, value in values.items():
        template = F.replace(template, F.lit(place), value)
    return template


def put(form: str, *texts: Column) -> Column:
    """Texts in the places ``{}`` of a fixed format; null if one of them is."""
    first, *rest = form.split("{}")
    parts = [F.lit(first)] + [part for text, after in zip(texts, rest, strict=True) for part in (text, F.lit(after))]
    return F.concat(*parts)


def case_text(prompt: Column, shown_output: Column) -> Column:
    return put(CASE, prompt, shown_output)


def rewrite_message(question: Column, answer: Column, cases: Column, correct: Column) -> Column:
    return put(REWRITE_MESSAGE, question, answer, cases, correct)


def pair_text(old: Column, new: Column) -> Column:
    return put(PAIR, old, new)


def rule_message(correct: Column) -> Column:
    return put(RULE_MESSAGE, correct)


def numbered_rule(number: Column, rule: Column) -> Column:
    return put(NUMBERED_RULE, number.cast("string"), rule)


def outcome_block(correct: Column, wrong: Column) -> Column:
    """Two listed blocks, each ``None`` when it is empty."""
    def listed(block: Column) -> Column:
        return F.coalesce(F.nullif(block, F.lit("")), F.lit("None"))
    return F.concat(F.lit("Correct:\n"), listed(correct), F.lit("\n---\nWrong:\n"), listed(wrong))


def refinement_text(old: Column, new: Column) -> Column:
    return F.concat(F.lit("   [Original X] "), old, F.lit("\n   [Fixed O]    "), new)


def refinement_log(pairs: Column, rule: Column) -> Column:
    return F.concat(F.lit("Successful Refinements:\n"), pairs, F.lit("\n\nGenerated Guideline:\n"), rule)
