"""The steps of a prompt-improvement job, each one table in and one written table out.

Every step that asks a model writes its answers before anything reads them twice.
Items have ``run_id, item_id, question, answer, type, subset``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions import templates as tp
from promptmill.functions.grading import grade
from promptmill.operators import refine, reports, requests, rules
from promptmill.operators.completion import ASKED_AT, REQUEST, Model, call_usage, complete, complete_once, request_id
from promptmill.operators.outcomes import ITEM, item_outcomes, prompt_accuracy
from promptmill.workspace import written


Step = Callable[[DataFrame], DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]

# Roles in usage and cost.
SCORER, OPTIMIZER = "scorer", "optimizer"


@dataclass(frozen=True)
class Models:
    """Builders of the model that answers questions and of the one that improves prompts."""
    scorer: Callable[[], Model]
    optimizer: Callable[[], Model]


@dataclass(frozen=True)
class Settings:
    group_size: int = 3
    output_prompts: int = 8
    iterative_prompts: int = 5
    max_tries: int = 3
    retry_delay: float = 1.0
    partitions: int | None = None
    rewrite_template: str = tp.REWRITE_TEMPLATE
    rule_template: str = tp.RULE_TEMPLATE
    merge_template: str = tp.MERGE_TEMPLATE
    generate_template: str = tp.GENERATE_TEMPLATE
    merge_order: str = "balanced"
    #: Left-deep folds of a run that one job makes; what they made is kept after each job.
    fold_steps: int = 200
    compat: bool = False
    #: Folder of token usage, one part a step, round and level, which a part played again overwrites; it belongs to one job.
    usage_folder: str | None = None
    #: Folder of answers that are kept: a job started again asks only what has none. It belongs to one job too.
    answers: str | None = None
    piece_calls: int = 100_000
    scorer_name: str | None = None
    optimizer_name: str | None = None
    #: Where in a job a step is asked: the iterative round, and the level of a merge.
    round: int = 0
    level: int = 0

    def ask(self, asked: DataFrame, model: Callable[[], Model], role: str, name: str, out: str = "response",
            strip: bool = True, then: Step | None = None, keep: Keep = written) -> DataFrame:
        """Answers, put through ``then`` and written once.

        With ``answers``, what was answered before is not asked again; with ``usage_folder``, token usage goes there.
        """
        part = f"{name}-{self.round}-{self.level}"
        keys = [c for c in asked.columns if c not in ("system", "user")]
        how = {"max_tries": self.max_tries, "retry_delay": self.retry_delay, "out": out, "partitions": self.partitions, "strip": strip}
        if self.answers:
            answers = complete_once(asked, model, f"{self.answers}/{part}", keys, self.piece_calls, **how)
        elif self.usage_folder:
            answers = complete(asked.withColumn(REQUEST, request_id(keys)), model, asked_at=ASKED_AT, **how)
        else:
            answers = complete(asked, model, **how)
        answers = keep(then(answers) if then else answers, name)
        if self.usage_folder:
            known = self.scorer_name if role == SCORER else self.optimizer_name
            call_usage(answers, role, known, name, self.round, self.level).write.mode("overwrite").parquet(f"{self.usage_folder}/{part}")
        return answers.drop(REQUEST, ASKED_AT)


def evaluate(asked: DataFrame, model: Callable[[], Model], settings: Settings, placement: str = "pool",
             grader: str = "strict", strip: bool = True, keep: Keep = written, name: str = "graded") -> DataFrame:
    """Answers to items × prompts, graded. The question stays behind once it is in the request."""
    requested = requests.with_request(asked, placement).drop("question")
    return settings.ask(
        requested, model, SCORER, name, "raw_output", strip, lambda answers: grade(answers, grader), keep)


def propose(graded: DataFrame, failures: DataFrame, items: DataFrame, models: Models,
            settings: Settings) -> DataFrame:
    """Wrong prompts with the rewrites the optimizer answers with."""
    asked = refine.rewrite_requests(failures, items, settings.rewrite_template)
    answers = settings.ask(asked, models.optimizer, OPTIMIZER, "rewrites")
    return refine.rewrite_pairs(item_outcomes(graded), answers)


def verify(pairs: DataFrame, items: DataFrame, models: Models, settings: Settings) -> DataFrame:
    """Rewrites asked and graded on their own item."""
    asked = pairs.join(items, ITEM)
    requested = requests.with_request(asked, "pool", prompt="new_prompt").drop("question")
    graded = settings.ask(requested, models.scorer, SCORER, "tried", "raw_output", then=grade)
    # Partitioned by item once, for the check by text and for the per-item steps after it.
    return refine.check_candidates(graded.repartition(*ITEM))


def distil(candidates: DataFrame, failures: DataFrame, models: Models, settings: Settings) -> DataFrame:
    """One rule per item with a verified pair; empty answers are dropped."""
    asked = rules.rule_requests(refine.verified_pairs(candidates), failures, settings.rule_template)
    answers = settings.ask(asked, models.optimizer, OPTIMIZER, "rules")
    return answers.where(F.length("response") > 0).select(*ITEM, F.col("response").alias("rule_text"))


def merge(blocks: DataFrame, keys: list[str], models: Models, settings: Settings) -> DataFrame:
    """Merged rule text per block."""
    asked = rules.merge_requests(blocks, keys, settings.merge_template)
    return settings.ask(asked, models.optimizer, OPTIMIZER, "merges", "rule_text").select(
        *keys, F.coalesce("rule_text", F.lit("")).alias("rule_text"))


def generate(texts: DataFrame, keys: list[str], count: int, models: Models, settings: Settings) -> DataFrame:
    """Up to ``count`` prompts per rule text; a failed call gives none."""
    asked = rules.generation_requests(texts, keys, count, settings.generate_template)
    return rules.generated_pool(settings.ask(asked, models.optimizer, OPTIMIZER, "prompts"), keys, count)


@dataclass
class Improved:
    """Tables of one improvement pass over items."""
    graded: DataFrame
    candidates: DataFrame
    status: DataFrame
    rules: DataFrame


def improve(asked: DataFrame, items: DataFrame, models: Models, settings: Settings, keep: Keep = written) -> Improved:
    """Evaluate, rewrite, verify and distil: four jobs over all items, however many.

    ``keep`` says where the graded outputs and candidates are written.
    """
    graded = evaluate(asked, models.scorer, settings, keep=keep)
    failures = written(refine.failure_cases(graded), "failures")
    pairs = propose(graded, failures, items, models, settings)
    candidates = keep(verify(pairs, items, models, settings), "candidates")
    outcomes = item_outcomes(graded, keep=("subset",))
    status = refine.item_status(
        outcomes, candidates, keep=("subset",), compat=settings.compat).withColumnRenamed("subset", "source")
    return Improved(graded, candidates, status, distil(candidates, failures, models, settings))


def held_out(items: DataFrame, prompts: list[str], model: Callable[[], Model], settings: Settings) -> DataFrame:
    """Accuracy of each prompt as the system text of held-out questions, by the loose grader."""
    asked = requests.ask_all(items, prompts)
    return prompt_accuracy(evaluate(asked, model, settings, "system", "loose", strip=False, name="held_out"))


def held_out_runs(items: DataFrame, pools: DataFrame, model: Callable[[], Model], settings: Settings) -> DataFrame:
    """Accuracy of every run's own prompts on its held-out items, all runs in one job.

    ``pools`` has ``run_id, prompt_pos, prompt``; a run without prompts is skipped.
    """
    asked = requests.ask_pools(items, pools, ["run_id"])
    return prompt_accuracy(evaluate(asked, model, settings, "system", "loose", strip=False, name="held_out"))


def held_out_report(accuracy: DataFrame, headers: DataFrame) -> DataFrame:
    """Report blocks of the runs in ``accuracy``."""
    return reports.report_blocks(accuracy, headers.join(accuracy.select("run_id").distinct(), "run_id", "left_semi"))
