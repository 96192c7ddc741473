"""Toxicity by compression distance.

Two zstandard dictionaries: one of ordinary text, one of toxic text. Toxic documents are mostly
ordinary text too, so the toxic dictionary ends in the same ordinary words, at the same distances,
and only what toxic documents hold besides makes the compressed lengths of a window differ.
A document's windows are compressed with both; how many bytes the toxic dictionary saves, at most in a
window and in all, is calibrated on labelled rows to a probability.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import fold_of, mapped, sigmoid

#: Bounds of the labelled sample: rows of each class (least hashes of the id), characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
WINDOW_WORDS = 12
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
#: A piece of a word, of these lengths in bytes, counts as toxic from this log-likelihood ratio and this
#: ratio of frequencies on.
GRAMS = (5, 7, 9)
LEAST_G2, LEAST_RATIO = 30.0, 5.0
THRESHOLD = 0.3
LABEL_FOLDS, HELD_OUT = 4, 2


@dataclass
class Model:
    """Dictionary contents and the weights of a logistic curve over a document's gains."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def _compressor(content: bytes):
    import zstandard as zstd
    params = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, strategy=zstd.STRATEGY_LAZY2,
        write_checksum=False, write_content_size=False, write_dict_id=False)
    words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(dict_data=words, compression_params=params).compress


def windows(text: bytes) -> list[bytes]:
    words = _lowered(text)
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def gains(texts: list[bytes | None], model: Model, compressors=None) -> np.ndarray:
    """For each text: most bytes saved in a window, all bytes saved, windows with a saving, windows."""
    ordinary, toxic = compressors or (_compressor(model.ordinary), _compressor(model.toxic))
    out = np.zeros((len(texts), 4))
    for k, text in enumerate(texts):
        if text:
            saved = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
            if saved:
                gain = [s for s in saved if s > 1]
                out[k] = max(saved), sum(gain), len(gain), len(saved)
    return out


def _features(gain: np.ndarray) -> np.ndarray:
    most, all_, many, windows_ = np.maximum(gain, 0).T
    return np.stack([np.ones(len(gain)), np.log1p(most), np.log1p(all_), np.log1p(many),
                     np.log1p(100 * all_ / np.maximum(windows_, 1)) / 4], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lowered(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def _contexts(texts: list[bytes]) -> Counter:
    """How many distinct words stand before each word: copies of a text add nothing."""
    seen, out = set(), Counter()
    for text in texts:
        words = _lowered(text)
        for pair in zip([b"", *words], words, strict=False):
            if (key := hash(pair)) not in seen:
                seen.add(key)
                out[pair[1]] += 1
    return out


def _spelled(word: bytes, lengths: tuple[int, ...]) -> set[bytes]:
    """Pieces of a word with its edges, of each length."""
    padded = b" " + word + b" "
    return {padded[i:i + k] for k in lengths for i in range(len(padded) - k + 1)}


def _telling(ours: Counter, theirs: Counter) -> set[bytes]:
    """Pieces that toxic text holds far more often, each for words that no better one explains."""
    n, m = sum(ours.values()), sum(theirs.values())
    # Fewer than this can't be evidence enough even if ordinary text holds none.
    least = LEAST_G2 / (2 * math.log((n + m) / n))
    toxic: dict[bytes, int] = {}
    for k in GRAMS:
        counts = Counter()
        for word, c in ours.items():
            for piece in _spelled(word, (k,)):
                counts[piece] += c
        toxic.update((piece, c) for piece, c in counts.items() if c >= least)
    ordinary: dict[bytes, int] = dict.fromkeys(toxic, 0)
    for word, c in theirs.items():
        for piece in _spelled(word, GRAMS):
            if piece in ordinary:
                ordinary[piece] += c

    def worth(piece: bytes) -> float:
        a, b = toxic[piece], ordinary[piece]
        return _g2(a, n, b, m) if a * m >= b * LEAST_RATIO * n else 0.0

    toxic = {piece: c for piece, c in toxic.items() if worth(piece) >= LEAST_G2}
    where: dict[bytes, list[bytes]] = {piece: [] for piece in toxic}
    for word in ours:
        for piece in _spelled(word, GRAMS):
            if piece in where:
                where[piece].append(word)
    out, heap, explained = set(), [(-worth(p), p) for p in toxic], set()
    heapq.heapify(heap)
    while heap:
        said, piece = heapq.heappop(heap)
        now = worth(piece)
        if now < LEAST_G2:
            continue
        if -said > now + 1e-9:
            heapq.heappush(heap, (-now, piece))
            continue
        out.add(piece)
        for word in where[piece]:
            if word not in explained:
                explained.add(word)
                for other in _spelled(word, GRAMS):
                    if other in toxic:
                        toxic[other] -= ours[word]
    return out


def _g2(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a of n against b of m."""
    p = (a + b) / (n + m)
    return 2 * sum(o * math.log(o / e) for o, e in (
        (a, n * p), (b, m * p), (n - a, n * (1 - p)), (m - b, m * (1 - p))) if o)


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries and calibration from labelled texts. Without both classes every score is the plain share."""
    if not toxic or not ordinary:
        share = 0.99 if toxic else 0.01
        return Model(b"a b", b"a b", np.array([math.log(share / (1 - share)), 0, 0, 0, 0.0]))
    words, common = _contexts(toxic), _contexts(ordinary)
    marked = _telling(words, common)
    telling = [w for w in words if not marked.isdisjoint(_spelled(w, GRAMS))]
    telling.sort(key=lambda w: (words[w], w))
    usual = sorted(common, key=lambda w: (common[w], w))

    def content(listed: list[bytes], most: int) -> bytes:
        """The last of ``listed`` that fit, most frequent last."""
        held, at = 0, len(listed)
        while at and held + len(listed[at - 1]) + 1 <= most:
            at -= 1
            held += len(listed[at]) + 1
        return b" ".join(listed[at:])

    base = b" " + content(usual, ORDINARY_BYTES) + b" "
    model = Model(base, b" " + content(telling, TOXIC_BYTES) + base, np.zeros(5))
    x = _features(gains(toxic + ordinary, model))
    model.weights = _logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))])
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most ``SAMPLE_ROWS`` labelled rows of each class, outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
             .where("_toxic in (0, 1) and _id is not null").where(fold_of("_id", LABEL_FOLDS) != HELD_OUT)
             .groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    shares = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * SAMPLE_ROWS rows of two numbers are broadcast.
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
            .where(F.length("_text").between(1, SAMPLE_CHARS)).join(F.broadcast(picked), "_id")
            .select("_text", "_toxic").collect())
    texts = {label: sorted({r["_text"].encode() for r in rows if r["_toxic"] == label}) for label in (0, 1)}
    model = train(texts[1], texts[0])
    if texts[0] and texts[1]:
        model.weights[0] += math.log(shares[1] / shares[0]) - math.log(len(texts[1]) / len(texts[0]))
    return model


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, most_saved, all_saved, n_windows, *keep) of every whole text.

    Null, empty and blank texts have no windows and get the score of a text without savings. Rows
    with equal ids are scored each for itself; null ids stay null. String columns in ``keep`` go along; others are never read.
    """
    held = []

    def piece(columns):
        ids, texts, *others = columns
        if not held:
            held.append((_compressor(model.ordinary), _compressor(model.toxic)))
        gain = gains(texts, model, held[0])
        score = sigmoid(_features(gain) @ model.weights)
        return ids, score, gain[:, 0].astype(np.int64), gain[:, 1].astype(np.int64), gain[:, 3].astype(np.int64), *others

    carried = [f"_c{k}" for k in range(len(keep))]
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column), *(F.col(c).alias(a) for c, a in zip(keep, carried, strict=True)))
    out = mapped(rows, piece, ", ".join(["doc_id long, score double, most_saved long, all_saved long, n_windows long", *(f"{c} string" for c in carried)]))
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...) of every document, by a model of the labels outside the fold."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id", (fold_of("doc_id", LABEL_FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "most_saved", "all_saved", "n_windows")
