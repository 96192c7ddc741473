"""Exact iterative runs played item by item inside a task, for runs whose chunks fill soon.

Such a run takes very many rounds over few items each. A round of them is one task anyway (``plans.rounds``), so a job
a round costs time and gives nothing: here a task has a stretch of a run's items, asks one after the other, and changes the
pool as soon as a chunk is full. Nothing is asked under a pool that is replaced meanwhile.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from promptmill.functions.grading import CORRECT, WRONG
from promptmill.functions.plain import cases_text, correct_list, fill, generated_prompts, outcome_of, pairs_text, put, request, rewrites_in, rules_text
from promptmill.functions.templates import COUNT, MERGE_MESSAGE, PAIRS, REWRITE_MESSAGE, RULE_MESSAGE, RULES, generate_message
from promptmill.operators.completion import ask
from promptmill.operators.refine import (
    NO_REWRITE, NO_RESPONSE, NOT_VERIFIED, NOTES, OUTPUT_IF_MISSING, OUTPUT_IF_VERIFIED, SKIPPED, SUCCESS)
from promptmill.operators.requests import HELPER
from promptmill.plans.steps import Models, Settings

# Sent to executors as code, so that the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a task takes and gives at once.
BATCH = 500
_CALL = ("tries", "error", "prompt_tokens", "completion_tokens")
Ask = Callable[[str, "str | None"], tuple]


def _status_of(n_correct: int, n_wrong: int, n_pairs: int, n_verified: int, compat: bool) -> str:
    if n_wrong == 0:
        return SKIPPED if n_correct > 0 or compat else NO_RESPONSE
    return NO_REWRITE if n_pairs == 0 else NOT_VERIFIED if n_verified == 0 else SUCCESS


class Improver:
    """What ``plans.rounds`` says of items and chunks in columns, of one at a time. ``settings``: those it reads, by name."""

    def __init__(self, score: Ask, better: Ask, settings: dict):
        self.score, self.better, self.settings = score, better, settings

    def _tried(self, prompt: str, question: str | None, answer: str | None, kind: str | None) -> dict:
        text, *call = self.score(*request(HELPER, prompt, question))
        return {"raw_output": text, **dict(zip(_CALL, call)), "outcome": outcome_of(text, answer, kind)}

    def item(self, pool: list[dict], question: str | None, answer: str | None, kind: str | None) -> dict:
        """``graded``, ``candidates``, ``status`` and ``rule_text`` of an item under a pool."""
        graded = [{**p, **self._tried(p["prompt"], question, answer, kind)} for p in pool]
        right = [x["prompt"] for x in graded if x["outcome"] == CORRECT]
        wrong = [(x["prompt"], x["raw_output"]) for x in graded if x["outcome"] == WRONG]
        rewrites, candidates, verified, rule = [], [], [], None
        if wrong:
            rewrites = rewrites_in(self.better(
                fill(self.settings["rewrite_template"], {COUNT: str(len(wrong))}),
                put(REWRITE_MESSAGE, question, answer, cases_text(wrong), correct_list(right)))[0])
        for i, ((old, _), new) in enumerate(zip(wrong, rewrites)):
            candidates.append({"pair_pos": i, "old_prompt": old, "new_prompt": new, **self._tried(new, question, answer, kind)})
        for x in candidates:
            same = [y for y in candidates if y["new_prompt"] == x["new_prompt"]]
            x["verified"] = any(y["outcome"] == CORRECT for y in same)
            missed = [y["raw_output"] for y in same if y["outcome"] == WRONG]
            x["model_output"] = missed[-1] if missed else OUTPUT_IF_VERIFIED if x["verified"] else OUTPUT_IF_MISSING
            if x["verified"]:
                verified.append((x["old_prompt"], x["new_prompt"]))
        if verified:
            rule = self.better(
                fill(self.settings["rule_template"], {PAIRS: pairs_text(verified)}),
                put(RULE_MESSAGE, correct_list(right)))[0]
        status = _status_of(len(right), len(wrong), len(candidates), len(verified), self.settings["compat"])
        return {"graded": graded, "candidates": candidates, "rule_text": rule or None, "status": {
            "status": status, "initial_wrong": len(wrong), "verified_success": len(verified), "note": NOTES.get(status, "")}}

    def chunk(self, rules: list[str]) -> tuple[str, list[str]]:
        """The merged text of a chunk's rules and the prompts made of it."""
        merged = self.better(fill(self.settings["merge_template"], {RULES: rules_text(rules)}), MERGE_MESSAGE)[0] or ""
        if not merged:
            return merged, []
        count = self.settings["iterative_prompts"]
        said = self.better(fill(self.settings["generate_template"], {COUNT: str(count), RULES: merged}), self.settings["generate_message"])
        return merged, generated_prompts(said[0], count)


class Stretch:
    """A run as far as its items in a task go. Rounds and their widths are counted as ``plans.rounds`` has them."""

    def __init__(self, run_id: int | None, state: dict, improver: Improver, group_size: int, block: int, most: int, wide: int):
        self.run_id, self.state, self.improver = run_id, {**state, "waiting": list(state["waiting"]), "n_rounds": 0}, improver
        self.group_size, self.block, self.most, self.wide = group_size, block, most, wide
        self.left = state["width"]
        #: Rows of the run: its chunks, and pools with the item from which they are in force.
        self.rows: list[dict] = []

    @property
    def is_open(self) -> bool:
        """Whether the run goes on here; a wide one is dealt to several tasks."""
        return self.state["width"] <= self.wide

    def play(self, ordinal: int, item_id: int | None, question: str | None, answer: str | None, kind: str | None) -> dict:
        state = self.state
        if state["is_new"]:
            state["is_new"] = False
            self.rows.append({"pools": _pool_from(state["pool"], 0)})
        done = self.improver.item(state["pool"], question, answer, kind)
        state["next"] = ordinal + 1
        self.left -= 1
        if done["rule_text"] is not None:
            state["waiting"].append({"item_id": item_id, "rule_text": done["rule_text"]})
            if len(state["waiting"]) == self.group_size:
                self._fill(item_id)
                return done
        if self.left == 0 or state["next"] == state["n_items"]:
            self._next_round(state["width"] * 2)
        return done

    def _fill(self, item_id: int | None) -> None:
        state = self.state
        merged, prompts = self.improver.chunk([x["rule_text"] for x in state["waiting"]])
        made = [{"prompt_pos": i, "prompt": p} for i, p in enumerate(prompts)]
        self.rows.append({
            "tier1": {"chunk": state["n_chunks"], "n_rules": self.group_size, "sample_idx": item_id, "is_tail": False, "rule_text": merged},
            "pools": _pool_from(made, None if item_id is None else item_id + 1)})
        n_played = state["n_earlier"] + state["next"]
        state.update(waiting=[], n_chunks=state["n_chunks"] + 1, pool=made or state["pool"])
        self._next_round(max(self.block, n_played * 2 // state["n_chunks"]))

    def _next_round(self, width: int) -> None:
        self.state["width"] = self.left = min(width, max(self.most, self.block))
        self.state["n_rounds"] += 1

    def ended(self) -> list[dict]:
        """The rows that are left, and at last the run's state."""
        if self.left < self.state["width"]:
            self.state["n_rounds"] += 1
        return [*self.rows, {"state": self.state}]


def _pool_from(pool: list[dict], valid_from: int | None) -> list[dict]:
    return [{"valid_from": valid_from, **p} for p in pool]


def _loose(kind: T.DataType) -> T.DataType:
    """The same type, everything in it nullable, as it comes from Arrow."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_loose(kind.keyType), _loose(kind.valueType), True)
    return kind


def player(models: Models, settings: Settings, block: int, most: int, wide: int,
           rows: T.StructType) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType]:
    """What a task does with its runs, for ``mapInArrow``, and the schema of what it gives, which is that of ``rows``.

    Rows come by run: its state (``is_run``), then its items by ``ordinal``, from the one that is next.
    """
    schema = _loose(rows)
    own = ("item", "run_id", "item_id")
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema if f.name not in own}
    names = schema.names
    used = {name: getattr(settings, name) for name in (
        "compat", "iterative_prompts", "rewrite_template", "rule_template", "merge_template", "generate_template")}
    used["generate_message"] = generate_message(settings.iterative_prompts)
    build, tries, group_size = (models.scorer, models.optimizer), (settings.max_tries, settings.retry_delay, True), settings.group_size

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, better = (lambda system, user, call=model(): ask(call, system, user, *tries) for model in build)
        improver, run = Improver(score, better, used), None

        def given(said: list[dict], of: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [of[n] if n in of else pa.array([x.get(n) for x in said], kinds[n]) for n in names], names)

        def of_runs(rows: list[tuple[int | None, dict]], kind: dict[str, pa.DataType]) -> pa.RecordBatch:
            said = [{**row, "is_run": True, "pools": row.get("pools", [])} for _, row in rows]
            none = {n: pa.nulls(len(rows), kind[n]) for n in ("item", "item_id")}
            return given(said, {"run_id": pa.array([r for r, _ in rows], kind["run_id"]), **none})

        kind = {}
        for whole in batches:
            kind = {n: whole.schema.field(n).type for n in own}
            for begin in range(0, whole.num_rows, BATCH):
                piece = whole.slice(begin, BATCH)
                at, said, made = [], [], []
                columns = [piece.column(n).to_pylist() for n in ("is_run", "run_id", "state", "ordinal", "item_id", "question", "answer", "type")]
                for i, (is_run, run_id, state, *item) in enumerate(zip(*columns)):
                    if is_run:
                        if run:
                            made += [(run.run_id, row) for row in run.ended()]
                        run = Stretch(run_id, state, improver, group_size, block, most, wide)
                    elif run.is_open:
                        at.append(i)
                        said.append({**run.play(*item), "is_run": False})
                if run and run.rows:
                    made += [(run.run_id, row) for row in run.rows]
                    run.rows = []
                if at:
                    played = piece.take(pa.array(at))
                    yield given(said, {n: played.column(n) for n in own})
                if made:
                    yield of_runs(made, kind)
        if run:
            yield of_runs([(run.run_id, row) for row in run.ended()], kind)
    return play, schema
