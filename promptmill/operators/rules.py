"""Rules: requesting, chunking, merge lineage, sections, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions import templates as tp
from promptmill.functions import text as tx
from promptmill.operators.ordered import BUCKET, lookup, with_dense_rank, with_ordinal
from promptmill.operators.outcomes import ITEM
from promptmill.operators.refine import in_order
from promptmill.workspace import written

# Tier names, and headings of a merged rule.
TIER1, FOLD, TAIL, CONVERGENCE, FINAL = "Tier-1", "Recursive/Tier-N", "Cleanup Tier-0", "Convergence", "FINAL"
HEADINGS = ("Guiding Tone", "Key Vocabulary", "Structural Elements", "Thinking Steps", "Do's", "Don'ts")


def rule_requests(verified: DataFrame, failures: DataFrame, template: str = tp.RULE_TEMPLATE,
                  keys: list[str] = ITEM) -> DataFrame:
    """One request per item with verified pairs, to say what made the rewrites work."""
    pairs = verified.select(
        *keys, "pair_pos", tp.pair_text(F.col("old_prompt"), F.col("new_prompt")).alias("_pair"),
    ).groupBy(*keys).agg(in_order("_pair", r"\n", "pair_pos").alias("pairs_block"))
    met = pairs.join(failures.select(*keys, "correct_list"), keys)
    return met.select(
        *keys, tp.fill(F.lit(template), {tp.PAIRS: F.col("pairs_block")}).alias("system"),
        tp.rule_message(F.col("correct_list")).alias("user"))


def size_ok(group_size: int) -> int:
    if group_size < 2:
        raise ValueError("group_size must be at least 2: merging single rules never ends")
    return group_size


def tier1_chunks(rules: DataFrame, group_size: int = 3, run: str = "run_id", position: str = "item_id",
                 width: int = BUCKET, order: str | None = None) -> DataFrame:
    """Every ``group_size`` rules of a run, in item order or that of ``order``, as one chunk; a short last one is the tail.

    ``sample_idx`` is the item that filled the chunk and ``rules_block`` its rules, numbered.
    """
    size = size_ok(group_size)
    placed = with_ordinal(rules, [run], order or position, "_ordinal", width).select(
        run, position, F.col("_ordinal"),
        F.floor(F.col("_ordinal") / size).alias("chunk"),
        (F.col("_ordinal") % size + 1).alias("_place"),
        "rule_text",
    ).withColumn("_text", tp.numbered_rule(F.col("_place"), F.col("rule_text")))
    return placed.groupBy(run, "chunk").agg(
        F.count("*").alias("n_rules"),
        F.max_by(position, "_ordinal").alias("sample_idx"),
        in_order("_text", r"\n\n", "_place").alias("rules_block"),
    ).withColumn("is_tail", F.col("n_rules") < size)


def merge_requests(blocks: DataFrame, keys: list[str], template: str = tp.MERGE_TEMPLATE) -> DataFrame:
    return blocks.select(
        *keys, tp.fill(F.lit(template), {tp.RULES: F.col("rules_block")}).alias("system"),
        F.lit(tp.MERGE_MESSAGE).alias("user"))


def generation_requests(rules: DataFrame, keys: list[str], count: int,
                        template: str = tp.GENERATE_TEMPLATE) -> DataFrame:
    """One request per rule text for ``count`` prompts; an empty rule asks for nothing."""
    return rules.where(F.length("rule_text") > 0).select(
        *keys, tp.fill(F.lit(template), {tp.COUNT: F.lit(str(count)), tp.RULES: F.col("rule_text")}).alias("system"),
        F.lit(tp.generate_message(count)).alias("user"))


def generated_pool(responses: DataFrame, keys: list[str], count: int | None) -> DataFrame:
    """Prompts of generation responses in order, the first ``count`` of each."""
    return responses.select(
        *keys, F.posexplode(tx.generated_prompts(F.col("response"), count)).alias("prompt_pos", "prompt"))


def merge_summary(chunks: DataFrame, group_size: int = 3, run: str = "run_id") -> DataFrame:
    """Per run: how many Tier-1 merges, folds, tails and convergence merges its rules lead to.

    With ``t`` full chunks of ``g`` rules there are ``1 + (t - g) div (g - 1)`` folds once
    ``t >= g``: the first takes g merges, each later one the last fold and g - 1 more.
    """
    g = size_ok(group_size)
    counted = chunks.groupBy(run).agg(
        F.count_if(F.col("n_rules") == g).alias("n_tier1"), F.count_if(F.col("n_rules") < g).alias("n_tail"))
    folds = F.when(F.col("n_tier1") < g, F.lit(0)).otherwise(1 + F.floor((F.col("n_tier1") - g) / (g - 1)))
    loose = F.when(F.col("n_folds") == 0, F.col("n_tier1")).otherwise(1 + (F.col("n_tier1") - g) % (g - 1))
    return counted.withColumn("n_folds", folds.cast("long")).withColumn(
        "n_left", (loose + F.col("n_tail")).cast("long")).withColumn("converges", F.col("n_left") > 1)


def merge_tree(chunks: DataFrame, group_size: int = 3, run: str = "run_id") -> DataFrame:
    """One row per merge with the merge it goes into and its place there.

    The lineage of folding the oldest ``group_size`` merges whenever that many exist, then
    merging what is left, in closed form: no loop, whatever the depth. ``parent_tier`` is
    null for the merge that is the final rule.
    """
    g = size_ok(group_size)
    summary = merge_summary(chunks, g, run)
    nodes = lookup(chunks.select(run, "chunk", "n_rules", "sample_idx"), summary, [run], "inner")
    t, folds = F.col("chunk") + 1, F.col("n_folds")
    full = F.col("n_rules") == g
    fold_of = F.when(t <= g, F.lit(1)).otherwise(1 + F.ceil((t - g) / (g - 1))).cast("long")
    # Tier-1 merges that were folded away before what is left was merged.
    folded = F.when(folds == 0, F.lit(0)).otherwise(g + (folds - 1) * (g - 1))
    left_place = t - folded + F.when(folds > 0, 1).otherwise(0)
    to_fold = full & (fold_of <= folds)
    to_end = ~to_fold & F.col("converges")
    place_in_fold = F.when(t <= g, t).otherwise(2 + (t - g - 1) % (g - 1))

    def node(tier, seq, sample, inputs, parent_tier, parent_seq, place):
        return F.struct(
            tier.alias("tier"), seq.cast("long").alias("seq"), sample.cast("string").alias("sample_idx"),
            inputs.cast("long").alias("n_inputs"), parent_tier.alias("parent_tier"),
            parent_seq.cast("long").alias("parent_seq"), place.cast("long").alias("parent_place"))

    chunk_node = node(
        F.when(full, TIER1).otherwise(TAIL), F.when(full, t).otherwise(1), F.col("sample_idx"), F.col("n_rules"),
        F.when(to_fold, FOLD).when(to_end, CONVERGENCE),
        F.when(to_fold, fold_of).when(to_end, 1),
        F.when(to_fold, place_in_fold).when(to_end, F.when(full, left_place).otherwise(F.col("n_left"))))
    is_last_input = full & (t >= g) & ((t - g) % (g - 1) == 0)
    this_fold = 1 + F.floor((t - g) / (g - 1))
    more = this_fold < folds
    fold_node = F.when(is_last_input, node(
        F.lit(FOLD), this_fold, F.col("sample_idx"), F.lit(g),
        F.when(more, FOLD).when(F.col("converges"), CONVERGENCE),
        F.when(more, this_fold + 1).when(F.col("converges"), 1),
        F.when(more | F.col("converges"), F.lit(1))))
    emitted = nodes.select(run, F.inline(F.filter(F.array(chunk_node, fold_node), lambda n: n.isNotNull())))
    last = summary.where("converges").select(
        run, F.inline(F.array(node(
            F.lit(CONVERGENCE), F.lit(1), F.lit(FINAL), F.col("n_left"), F.lit(None).cast("string"),
            F.lit(None), F.lit(None)))))
    return emitted.unionByName(last)


def rule_sections(rules: DataFrame, keep: list[str]) -> DataFrame:
    """One row per headed section of a rule; talk before the first heading and after a ruled line is left out."""
    names = "|".join(HEADINGS)
    pattern = rf"(?ms)^\[({names})\][ \t]*\r?\n(.*?)(?=^\[(?:{names})\]|^-{{3,}}[ \t]*\r?$|\z)"
    found = F.arrays_zip(
        F.regexp_extract_all("rule_text", F.lit(pattern), F.lit(1)).alias("heading"),
        F.regexp_extract_all("rule_text", F.lit(pattern), F.lit(2)).alias("body"))
    return rules.select(*keep, F.inline(found)).withColumn("body", tx.strip(F.col("body")))


def rule_consensus(rules: DataFrame, keys: list[str], heading: str = "Key Vocabulary") -> DataFrame:
    """Terms of a section by the number of distinct rules that hold them, most first.

    Counting distinct rules first removes repeats per term and rule and then adds up
    partial counts, so a term every rule holds is not one task's work.
    """
    sections = rule_sections(rules, keys).where(F.col("heading") == heading)
    terms = sections.select(*keys, F.explode(F.split("body", ",")).alias("term")).withColumn(
        "term", F.lower(tx.strip(F.col("term")))).where("term <> ''")
    counted = terms.groupBy("term").agg(F.count_distinct(*keys).alias("n_rules"))
    # Ranking reads the counts twice; the rules are read once.
    return with_dense_rank(written(counted, "terms"), "n_rules")
