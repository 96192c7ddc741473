"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are pre-aggregated to cells (source, language, topic) with their tokens. Sweeps rake the
cells' weights to the target of each marginal in turn, never above the tokens a cell has, so that a
document's probability is its cell's weight over its tokens. Sampling compares that probability with a
number drawn from the document's id and text, so a lost task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.common import mapped
from promptmill.workspace import written

MARGINALS = ("source", "lang", "topic")
#: Share of all tokens to draw, power that tempers natural shares to targets, sweeps over the marginals, number of topics.
FRACTION, TEMPER, SWEEPS, TOPICS = 0.5, 0.5, 12, 8
#: A topic is named after the most frequent word of at least this many letters.
TOPIC_LETTERS = 4


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              source_column: str = "source", lang_column: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, tokens, topic, draw, *keep) of every whole text.

    ``draw`` is a number in [0, 1) from id and text, the same on every run.

    Tokens are runs of anything but ASCII white space. The topic is a bucket of the most frequent
    word of ``TOPIC_LETTERS`` bytes or more (ties to the least in byte order), lowered in A-Z; none has topic -1.
    A null source or language is a marginal value of its own, the empty text.
    """
    import hashlib
    from collections import Counter

    def piece(columns):
        ids, sources, langs, texts, *others = columns
        tokens, topics, draws = [], [], []
        for id_, text in zip(ids, texts, strict=True):
            drawn = hashlib.md5(f"mix|{'' if id_ is None else id_}|".encode() + (text or b"")).hexdigest()[:8]
            draws.append(int(drawn, 16) / (1 << 32))
            words = text.lower().split() if text else []
            tokens.append(len(words))
            counts = Counter(w for w in words if len(w) >= TOPIC_LETTERS)
            most = max(counts.values(), default=0)
            word = min((w for w, n in counts.items() if n == most), default=None)
            topics.append(int(hashlib.md5(word).hexdigest()[:4], 16) % TOPICS if word else -1)
        return ids, sources, langs, tokens, topics, draws, *others

    carried = [f"_c{k}" for k in range(len(keep))]
    rows = docs.select(F.col(id_column).cast("long"), F.coalesce(F.col(source_column), F.lit("")), F.coalesce(F.col(lang_column), F.lit("")),
                       F.col(text_column), *(F.col(c).alias(a) for c, a in zip(keep, carried, strict=True)))
    out = mapped(rows, piece, ", ".join(["doc_id long, source string, lang string, tokens long, topic int, draw double", *(f"{c} string" for c in carried)]), weigh=3)
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def raked(cells: DataFrame, marginals: tuple[str, ...] = MARGINALS, fraction: float = FRACTION, temper: float = TEMPER,
          sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (marginals, tokens) with ``weight``, the tokens to draw from each.

    Targets: a marginal value's share of the drawn tokens goes as its natural share to the power
    ``temper``. A value whose cells are all drawn whole stays below its target; sweeps end at the fitted weights
    of the others. Every table here has one row per cell, not per document.
    """
    drawn = fraction * (cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
    now = cells.withColumn("weight", F.col("tokens").cast("double") * fraction)
    for m in marginals:
        # One number a marginal: the sum of its tempered values, in decimals, which add up alike in any order.
        tempered = F.pow(F.sum("tokens").cast("double"), F.lit(temper)).cast("decimal(28,10)")
        total = cells.groupBy(m).agg(tempered.alias("n")).agg(F.sum("n").cast("double")).first()[0] or 1.0
        natural = F.sum("tokens").over(Window.partitionBy(m))
        now = now.withColumn(f"_target_{m}", drawn * F.pow(natural.cast("double"), F.lit(temper)) / total)
    now = written(now, "targets")
    for sweep in range(sweeps):
        for m in marginals:
            held = F.sum("weight").over(Window.partitionBy(m))
            now = now.withColumn("weight", F.when(held > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"_target_{m}") / held)).otherwise(0.0))
        if sweep % 4 == 3:
            now = written(now, "raked")
    return now.select(*marginals, "tokens", "weight")


def sampled(docs: DataFrame, keep: tuple[str, ...] = (), fraction: float = FRACTION) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, taken, *keep) of every document.

    Documents without tokens have probability 0. Rows of equal id and text draw the same number, so
    repeated rows are taken or left together; null ids count as the empty text, and their rows draw by their texts. An empty table gives an empty one. The cells, at most one row per combination that
    occurs, are joined back; hot cells are no hot groups, since only sums of them are shuffled.
    """
    told = written(described(docs, keep=keep), "described")
    cells = written(told.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = raked(cells, fraction=fraction).select(*MARGINALS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("probability"))
    return (told.join(weights, [*MARGINALS]).withColumn("taken", F.col("draw") < F.col("probability"))
            .select("doc_id", "source", "lang", "topic", "tokens", "probability", "taken", *keep))
