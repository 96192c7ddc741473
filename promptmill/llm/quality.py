"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank, so a text is scored in time linear in its features:
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import Memo, fold_of, mapped, sigmoid, word_names

#: Bounds of the labelled sample: rows of each class (least hashes of the id), characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
#: Hashed word slots, rank of the interactions, passes of training.
SLOTS, RANK, EPOCHS = 1 << 14, 8, 12
THRESHOLD = 0.3
LABEL_FOLDS, HELD_OUT = 5, 0
STATISTICS = 12


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text and its length, each about 0 to 1."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct = len(set(words)) / n
    marks = sum(text.count(m) for m in (b"#", b"*", b"$", b"%", b"&", b"<", b">"))
    return [np.log1p(len(words)) / 10, np.log1p(size) / 14, min(1.0, 10 * marks / size), min(1.0, 4 * text.count(b"|") / n),
            sum(1 for w in words if len(w) > 1 and w.isupper()) / n, min(1.0, 2 * text.count(b"!") / n), distinct,
            1 - len(set(lines)) / max(1, len(lines)), min(1.0, sum(map(len, words)) / n / 20),
            min(1.0, 4 * (text.count(b".") + text.count(b",")) / n), min(1.0, 10 * len(lines) / n),
            min(1.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)]


def features(names: Memo, texts: list[bytes | None]):
    """Slots and values of all texts in one list, and where each text begins; statistics come first."""
    slots, values, at = [], [], np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        text = text or b""
        words = text.split()
        own = np.unique(np.fromiter((names[w] for w in words), np.uint64, len(words)) % np.uint64(SLOTS)).astype(np.int64)
        slots += [np.arange(STATISTICS), own + STATISTICS]
        values += [np.array(statistics(text, words)), np.full(len(own), 1 / np.sqrt(max(1, len(own))))]
        at[k + 1] = at[k] + STATISTICS + len(own)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0), at
    return np.concatenate(slots), np.concatenate(values), at


def raw_scores(machine: Machine, slots, values, at) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for each text, and the sums over its features that gradients need."""
    if len(at) == 1:
        return np.zeros(0), np.zeros((0, RANK))
    weighted = machine.factors[slots] * values[:, None]
    sums = np.add.reduceat(weighted, at[:-1])
    squares = np.add.reduceat(weighted ** 2, at[:-1])
    return (machine.bias + np.add.reduceat(machine.linear[slots] * values, at[:-1])
            + 0.5 * (sums ** 2 - squares).sum(1)), sums


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss, Adam, mini-batches; the same texts give the same machine."""
    rng = np.random.default_rng(seed)
    size = STATISTICS + SLOTS
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        machine.factors[:] = 0
        return machine
    slots, values, at = features(word_names(), texts)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (machine.linear, machine.factors)]
    step, rate, l2 = 0, 0.02, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 64):
            batch = order[lo:lo + 64]
            parts = [np.arange(at[k], at[k + 1]) for k in batch]
            where = np.concatenate(parts)
            begins = np.zeros(len(batch) + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=begins[1:])
            s, x = slots[where], values[where]
            score, sums = raw_scores(machine, s, x, begins)
            wrong = np.repeat((sigmoid(score) - labels[batch]) / len(batch), np.diff(begins))
            linear = np.bincount(s, wrong * x, minlength=size) + l2 * machine.linear
            pull = wrong[:, None] * x[:, None] * (np.repeat(sums, np.diff(begins), axis=0) - machine.factors[s] * x[:, None])
            factors = np.stack([np.bincount(s, pull[:, f], minlength=size) for f in range(RANK)], 1) + l2 * machine.factors
            machine.bias -= rate * float((sigmoid(score) - labels[batch]).mean())
            step += 1
            for p, g, (m, v) in zip((machine.linear, machine.factors), (linear, factors), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return machine


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from at most ``SAMPLE_ROWS`` labelled rows of each class, outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
             .where("_y in (0, 1) and _id is not null").where(fold_of("_id", LABEL_FOLDS) != HELD_OUT)
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    least = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    # At most 2 * SAMPLE_ROWS rows of two numbers are broadcast.
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
            .where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(least[0].unionByName(least[1])), "_id")
            .select("_text", "_y").collect())
    told = sorted({(r["_text"].encode(), r["_y"]) for r in rows})
    y = np.array([t[1] for t in told], np.float64)
    machine = train([t[0] for t in told], y)
    if 0 < y.sum() < len(y):  # classes are sampled evenly: back to their shares among the labels
        machine.bias += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return machine


def scored(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: how likely it is of good quality.

    Null and empty texts are scored on their statistics alone. Rows are scored each for itself; null ids
    stay null; other columns are never read. The machine has a fixed size (about 1 MB).
    """
    names = word_names()

    def piece(columns):
        ids, texts = columns
        return ids, sigmoid(raw_scores(machine, *features(names, texts))[0])

    return mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column)), piece, "doc_id long, score double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by labels outside the held-out fold."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id", (fold_of("doc_id", LABEL_FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
