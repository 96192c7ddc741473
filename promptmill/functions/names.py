"""Run names: what a run directory is called, and reading such names back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and the time layout in run names.
TIME = "yyyyMMdd-HHmmss"
ALL, SUBS, NO_SUBSET, LIMIT, ITERATIVE, BASE = "All", "Sub", "NA", "Lim", "Iter", "Base"
# Fixed value: an optional leading word, models, dataset, subset label, limit, mode, count, time.
# Older names carry neither dataset nor subset, and write IterOn and IterOff.
NAME = (
    r"(?:[A-Z]+_)?([^_/]+-[^_/]+)_([^_/]+-[^_/]+)(?:_([A-Z0-9]+)_(All|NA|\d+Sub))?_Lim(?:it)?(-?\d+)"
    r"_(Iter|Base|IterOn|IterOff)(?:_(\d+))?_(\d{8}-\d{6})"
)
PARTS = ("target_model", "optimizer_model", "dataset", "subset_label", "limit", "mode", "prompt_count", "started")


def subset_label(task: Column, subsets: Column) -> Column:
    return F.when(task != "mmlu", NO_SUBSET).when(subsets == "all", ALL).otherwise(
        F.concat(F.size(F.split(subsets, ",")).cast("string"), F.lit(SUBS)))


def run_name(target: Column, optimizer: Column, task: Column, subsets: Column, limit: Column,
             iterative: Column, prompt_count: Column, started: Column, prefix: str = "") -> Column:
    def safe(model: Column) -> Column:
        return F.replace(model, F.lit(":"), F.lit("-"))
    return F.concat_ws(
        "_", *([F.lit(prefix)] if prefix else []), safe(target), safe(optimizer), F.upper(task),
        subset_label(task, subsets), F.concat(F.lit(LIMIT), limit.cast("string")),
        F.when(iterative, ITERATIVE).otherwise(BASE),
        F.when(iterative, prompt_count.cast("string")).otherwise("0"), F.date_format(started, TIME))


def run_parts(path: Column) -> list[Column]:
    """Pieces of the run name in a path or file name; null where a name lacks one."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, NAME, i), F.lit(""))
    mode = F.when(part(6).isin("Iter", "IterOn"), ITERATIVE).when(part(6).isNotNull(), BASE)
    columns = [part(1), part(2), part(3), part(4), part(5).cast("int"), mode, part(7).cast("int"), part(8)]
    return [c.alias(name) for c, name in zip(columns, PARTS)]
