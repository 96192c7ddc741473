"""Substring dedup by recompression.

Rounds of run and pair naming shorten every document's word sequence. A name is a function of
what it names, so one round gives the same pair or run the same name everywhere on the cluster
and equal passages get equal symbols in their interior. For each symbol the rounds also keep the
span of words that decided it. A window is filed under a highest symbol whose deciding span lies
inside the window (that of the longest span); equal windows are then filed under equal symbols at the
same place, wherever they stand. Spark groups the symbols: one held by a single document
reveals nothing; one whose occurrences all have the same surroundings settles all of its windows
at once; only windows of the remaining symbols are compared one by one, by 128-bit names.
Windows that hold no such symbol (long runs, periodic text) are filed under their own name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.common import mapped, mixed, named, word_names
from promptmill.workspace import dropped, written

WINDOW = 50
ROUNDS = 7
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = frozenset({0})

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


class Level:
    """Symbols of one round: name, span of words [start, end), deciding span [ds, de)."""

    __slots__ = ("name", "ds", "de", "doc")

    def __init__(self, name, ds, de, doc):
        self.name, self.ds, self.de, self.doc = name, ds, de, doc


def rounds(names: np.ndarray, at: np.ndarray, count: int = ROUNDS):
    """The levels of all documents of a piece; document k has words at[k]..at[k+1]."""
    n = len(names)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pos = np.arange(n, dtype=np.int64)
    level = Level(names, pos, pos + 1, doc)
    yield level
    for r in range(count):
        if r in RUN_ROUNDS:
            level = _runs(level, at, r)
        level = _pairs(level, at, r)
        yield level


def _neighbours(level: Level, at: np.ndarray):
    """Deciding spans of the symbols left and right; beyond a document's edge no window reaches."""
    same = level.doc[1:] == level.doc[:-1]
    left, right = at[level.doc] - 1, at[level.doc + 1] + 1
    left[1:][same] = level.ds[:-1][same]
    right[:-1][same] = level.de[1:][same]
    return same, left, right


def _runs(level: Level, at: np.ndarray, r: int) -> Level:
    if not len(level.name):
        return level
    same, left, right = _neighbours(level, at)
    first = np.ones(len(level.name), bool)
    first[1:] = ~(same & (level.name[1:] == level.name[:-1]))
    i = np.flatnonzero(first)
    last = np.append(i[1:], len(first)) - 1
    length = (last - i + 1).astype(np.uint64)
    name = np.where(length > 1, mixed(level.name[i] + length * np.uint64(_B1) + np.uint64(2 * r + 1)), level.name[i])
    return Level(name, left[i], right[last], level.doc[i])


def _pairs(level: Level, at: np.ndarray, r: int) -> Level:
    if not len(level.name):
        return level
    same, left, right = _neighbours(level, at)
    opens = (mixed(level.name + np.uint64((_B2 * (r + 1)) & _MASK)) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(opens), bool)
    pair[:-1] = same & opens[:-1] & ~opens[1:]
    second = np.zeros(len(opens), bool)
    second[1:] = pair[:-1]
    i = np.flatnonzero(~second)
    paired = pair[i]
    j = i + paired
    name = np.where(paired, mixed(mixed(level.name[i] + np.uint64(_B2)) + level.name[j] * np.uint64(_B1)), level.name[i])
    # Alone, a symbol that could open a pair was decided by the one after it, any other by the one before it.
    ds = np.where(paired | opens[i], level.ds[i], left[i])
    de = np.where(paired | ~opens[i], level.de[j], right[i])
    return Level(name, ds, de, level.doc[i])


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Spans:
    """Names of any span of words, from two polynomials over the words' names."""

    def __init__(self, names: np.ndarray, bases: tuple[int, ...] = (_B1, _B2)):
        self.parts = []
        for base in bases:
            up, down = powers(len(names), base)
            sums = np.zeros(len(names) + 1, np.uint64)
            np.cumsum(mixed(names + np.uint64(base)) * up[:-1], out=sums[1:])
            self.parts.append((sums, down))

    def of(self, lo: np.ndarray, hi: np.ndarray, part: int) -> np.ndarray:
        sums, down = self.parts[part]
        return mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _order(level: Level) -> np.ndarray:
    """Longest deciding span first, then least name: what tells a window apart best, whatever surrounds it."""
    short = np.uint64(63) - np.minimum(level.de - level.ds, 63).astype(np.uint64)
    return short << np.uint64(58) | mixed(level.name) >> np.uint64(6)


def _least(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the first least value of ``order`` in each range [lo, hi), none of them empty."""
    out = np.empty(len(lo), np.int64)
    size, best = (hi - lo), np.arange(len(order))
    step = 1
    while len(lo):
        here = np.flatnonzero((size >= step) & (size < 2 * step))
        if len(here):
            left, right = best[lo[here]], best[hi[here] - step]
            out[here] = np.where(order[right] < order[left], right, left)
        if step * 2 > size.max():
            return out
        left, right = best[:-step], best[step:]
        best = np.where(order[right] < order[left], right, left)
        step *= 2
    return out


def filed(names: np.ndarray, at: np.ndarray, window: int):
    """Each window's symbol, as runs of windows with the same one: symbol, surroundings, first window, windows."""
    n = len(names)
    none = np.zeros(0, np.int64)
    if not n:
        return none.view(np.uint64), none.view(np.uint64), none, none
    last = np.repeat(np.maximum(at[1:] - window, at[:-1] - 1), np.diff(at))
    p = np.flatnonzero(np.arange(n, dtype=np.int64) <= last)  # where a window begins
    symbol, start = np.zeros(len(p), np.uint64), np.full(len(p), -1, np.int64)
    left = np.arange(len(p))
    for level in reversed(list(rounds(names, at))):
        if not len(left):
            break
        # Symbols decided inside the window at q: those from lo[q] to before hi[q].
        lo = np.cumsum(np.bincount(level.ds + 1, minlength=n + 2))
        hi = np.cumsum(np.bincount(level.de, minlength=n + 2))
        q = p[left]
        lo, hi = lo[q], hi[np.minimum(q + window, n + 1)]
        got = lo < hi
        at_, left, lo, hi = left[got], left[~got], lo[got], hi[got]
        if not len(at_):
            continue
        turn = np.ones(len(at_), bool)
        turn[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        i = np.flatnonzero(turn)
        found = np.repeat(_least(_order(level), lo[i], hi[i]), np.diff(np.append(i, len(at_))))
        symbol[at_], start[at_] = level.name[found], level.ds[found]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (symbol[1:] != symbol[:-1]) | (start[1:] < 0) | (p[1:] != p[:-1] + 1)
    i = np.flatnonzero(new)
    first, count = p[i], np.diff(np.append(i, len(p)))
    symbol, start = symbol[i], start[i]
    spans = Spans(names)
    around = spans.of(first, first + count + (window - 1), 0)
    offset = np.where(start >= 0, start - first, 0).astype(np.uint64)
    key = np.where(start >= 0, mixed(symbol + np.uint64(7)), spans.of(first, first + window, 1))
    return key, mixed(around + offset * np.uint64(_B2)), first, count


def symbols_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (symbol, around, doc_id, tid, uid, first, windows) of every (doc_id, text, tid, uid)."""
    names = word_names()

    def piece(columns):
        ids, texts, tids, uids = columns
        _, flat, at = named(names, texts)
        key, around, first, count = filed(flat, at, window)
        doc = np.searchsorted(at, first, side="right") - 1
        return key.view(np.int64), around.view(np.int64), np.array(ids)[doc], np.array(tids)[doc], np.array(uids)[doc], (first - at[doc]).astype(np.int32), count.astype(np.int32)

    return mapped(docs, piece, "symbol long, around long, doc_id long, tid long, uid long, first int, windows int")


def windows_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """128-bit names (w1, w2) of the windows in ``marks`` (first, windows, whole), not whole, of each (doc_id, text, tid, uid, marks)."""
    names = word_names()

    def piece(columns):
        ids, texts, tids, uids, marks = columns
        _, flat, at = named(names, texts)
        spans = Spans(flat)
        where, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, listed in enumerate(marks):
            listed = [np.arange(m["first"], m["first"] + m["windows"]) for m in listed if not m["whole"]]
            if listed:
                p = np.unique(np.concatenate(listed))
                where.append(p + at[k])
                doc.append(np.full(len(p), k))
        p, doc = np.concatenate(where), np.concatenate(doc)
        return (spans.of(p, p + window, 0).view(np.int64), spans.of(p, p + window, 1).view(np.int64),
                np.array(ids, np.int64)[doc], np.array(tids, np.int64)[doc], np.array(uids, np.int64)[doc], (p - at[doc]).astype(np.int32))

    return mapped(docs, piece, "w1 long, w2 long, doc_id long, tid long, uid long, first int")


#: Rows are told apart by id and text (as two 64-bit hashes), so that rows with equal ids do no harm, however many.
_KEY = ("doc_id", "tid", "uid")


def _lists(df: DataFrame, *columns: str) -> DataFrame:
    """Marks of each id and text; those of its copies are the same and count once."""
    return df.groupBy(*_KEY).agg(F.collect_set(F.struct(*columns)).alias("marks"))


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of windows (doc_id, tid, uid, first, windows, whole) of (doc_id, text, tid, uid) under shared symbols.

    ``whole``: an earlier document has the same symbol in the same surroundings, so all of the
    run's windows repeat. The others are the first of their surroundings while the symbol also has
    other ones; their windows have to be compared one by one.
    """
    filed_under = written(symbols_of(docs, window), "symbols")
    shared = filed_under.groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    met = written(filed_under.join(shared.select("symbol"), "symbol"), "shared_symbols")
    dropped(filed_under)
    firsts = met.groupBy("symbol", "around").agg(F.min("doc_id").alias("lo"))
    several = firsts.groupBy("symbol").agg(F.count("*").alias("n"))
    marks = written(
        met.join(firsts, ["symbol", "around"]).join(several, "symbol").where("doc_id > lo or n > 1")
        .select(*_KEY, "first", "windows", (F.col("doc_id") > F.col("lo")).alias("whole")), "marks")
    dropped(met)
    return marks


#: Stands for a null id; it is the smallest.
_NO_ID = -(1 << 63)


def _plain(id_column: str, text_column: str) -> list[Column]:
    text = F.col(text_column)
    said = F.coalesce(text, F.lit(""))
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text.alias("text"),
            F.xxhash64(said).alias("tid"), F.xxhash64(F.lit(1), said).alias("uid")]


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *keep): every text without the words of repeated windows.

    A window is ``window`` consecutive words (anything but ASCII white space) of one document; its
    words go if its word sequence also starts in a document with a smaller id. Windows are judged on
    the input. Null and empty texts have no words and keep an empty text. Rows with equal ids take
    nothing from each other, and each has its own result; null ids count as the smallest id
    and stay null.
    String columns in ``keep`` go along; others are ignored. Kept words are joined by one space.
    """
    plain = docs.select(*_plain(id_column, text_column))
    marks = marked(plain, window)
    looked = plain.join(_lists(marks, "first", "windows", "whole"), [*_KEY]).where("exists(marks, m -> not m.whole)")
    # One row per document and window at most stands under a name.
    same = Window.partitionBy("w1", "w2")
    single = (windows_of(looked.select("doc_id", "text", "tid", "uid", "marks"), window)
              .withColumn("lo", F.min("doc_id").over(same)).where("doc_id > lo")
              .select(*_KEY, "first", F.lit(1).alias("windows")))
    gone = _lists(marks.where("whole").select(*_KEY, "first", "windows").unionByName(single), "first", "windows")

    def piece(columns):
        ids, texts, marked, *others = columns
        n_words, n_removed, kept = [], [], []
        for text, listed in zip(texts, marked, strict=True):
            words = text.split() if text else []
            if listed:
                edges = np.zeros(len(words) + 1, np.int32)
                lo = np.array([m["first"] for m in listed])
                hi = lo + np.array([m["windows"] for m in listed]) + (window - 1)
                np.add.at(edges, lo, 1)
                np.add.at(edges, hi, -1)
                stay = np.cumsum(edges[:-1]) == 0
                rest = [words[i] for i in np.flatnonzero(stay)]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest).decode())
        return ids, n_words, n_removed, kept, *others

    carried = [f"_c{k}" for k in range(len(keep))]
    rows = docs.select(*_plain(id_column, text_column), *(F.col(c).alias(a) for c, a in zip(keep, carried, strict=True))) if keep else plain
    out = mapped(rows.join(gone, [*_KEY], "left").select("doc_id", "text", "marks", *carried), piece,
                 ", ".join(["doc_id long, n_words long, n_removed long, kept string", *(f"{c} string" for c in carried)]))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID))).withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
