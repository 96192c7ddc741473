"""Groups of spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words differ by exactly one inserted, deleted or replaced code point where their common prefix and
common suffix together reach the longer length minus one. Words are laid out as padded code-point matrices,
and a tile compares all rows of one matrix with all rows of another, column by column.

Which matrices meet: the longer word's length M cuts any such pair at h = (M - 1) // 2. Either their first h code
points agree, or their last M - h do. So every word goes into four groups (as the longer word and as the
shorter one, by prefix and by suffix), and tiles hold words of one length M, one side and agreeing keys.
Small groups share a tile; a large one is cut into blocks, and each pair of blocks is a tile of its own.
A tile hands on one row a word (how many are near it, and the best of them), never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.workspace import dropped, written

LEAST_LENGTH, LEAST_COUNT, TIMES, DELETES = 5, 3, 2, 97
#: Distinct words that a counting task holds before it hands them on (they are summed again afterwards).
HELD_WORDS = 100_000
#: Words of a block of a large group, and words that small groups fill a tile up to.
BLOCK, FILLED = 1024, 256
#: Characters of a text that are cut into words at a time (up to the end of a word).
SLICE = 1 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slices(text: str) -> Iterator[str]:
    """A long text in parts that end between words."""
    lo = 0
    while lo < len(text):
        hi = min(lo + SLICE, len(text))
        if hi < len(text) and (inside := _RUN.match(text, hi - 1)):
            hi = max(hi, inside.end())
        yield text[lo:hi]
        lo = hi


def misspelt(run: str, begun: int) -> str:
    """``run`` without one letter where the rule says so; ``begun`` is the crc32 of the text's id and a colon."""
    h = zlib.crc32(run.encode(), begun)
    if h % DELETES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_into(words: Counter, doc_id: str | None, text: bytes | None) -> None:
    """Add the words of a whole text that have at least LEAST_LENGTH letters."""
    begun = zlib.crc32(f"{doc_id or ''}:".encode())
    # Lower-casing bytes changes A-Z only.
    for part in slices(text.lower().decode()) if text else ():
        for run, n in Counter(_RUN.findall(part)).items():
            if len(run) >= LEAST_LENGTH and len(word := misspelt(run, begun)) >= LEAST_LENGTH:
                words[word] += n


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of all words with at least LEAST_COUNT occurrences over all whole texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=schema)
            words.clear()
            return held

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                count_into(words, doc_id.as_py(), text.as_py())
                if len(words) >= HELD_WORDS:
                    yield out()
        yield out()

    return (docs.select(F.col(id_column).cast("string"), F.col(text_column)).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def _keyed(words: DataFrame) -> DataFrame:
    """(longer, side, key, word, n): the four groups of every word."""
    length = F.length("word")
    half = ((F.col("longer") - 1) / 2).cast("int")
    ways = F.array(*(F.struct((length + more).cast("int").alias("longer"), F.lit(side).alias("side")) for more in (0, 1) for side in ("prefix", "suffix")))
    rows = words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.longer", "w.side")
    part = F.when(F.col("side") == "prefix", F.col("word").substr(F.lit(1), half)).otherwise(
        F.col("word").substr(length - (F.col("longer") - half) + 1, F.col("longer") - half))
    return rows.withColumn("key", part)


def _listed(a: Column, n: Column) -> list[Column]:
    """Words of a tile in one text, each padded to the tile's length, and their counts in the same order."""
    return [F.array_join(F.transform(a, lambda x: F.rpad(x["word"], F.col("longer"), " ")), ""), F.transform(n, lambda x: x["n"])]


def tiles(words: DataFrame) -> DataFrame:
    """(longer, side, a, a_n, b, b_n): matrices to compare; b is null where a is compared with itself."""
    keyed = _keyed(words)
    group = ["longer", "side", "key"]
    sizes = written(keyed.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1"), "group_sizes")
    # One row a length and side: how many tiles its small groups fill.
    filled = sizes.where(F.col("size") <= BLOCK).groupBy("longer", "side").agg(F.greatest(F.lit(1), (F.sum("size") / FILLED).cast("long")).alias("filled"))
    sizes = sizes.join(filled, ["longer", "side"], "left")
    rows = keyed.join(sizes, group)
    entry = F.struct("word", "n")
    small = (rows.where(F.col("size") <= BLOCK).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("filled")))
             .groupBy("longer", "side", "tile").agg(F.collect_list(entry).alias("a"))
             .select("longer", "side", "a", F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("b")))
    blocks = F.ceil(F.col("size") / BLOCK)
    large = (rows.where(F.col("size") > BLOCK).withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
             .groupBy(*group, "blocks", "block").agg(F.collect_list(entry).alias("held")))
    large = written(large, "blocks")
    other = large.select(*group, F.col("block").alias("other"), F.col("held").alias("b"))
    crossed = large.join(other, group).where("block <= other").select(
        "longer", "side", F.col("held").alias("a"), F.expr("if(block = other, null, b)").alias("b"))
    both = small.unionByName(crossed).repartition(F.xxhash64("a", "b"))
    return both.select("longer", "side", *(c.alias(name) for c, name in zip(
        [*_listed(F.col("a"), F.col("a")), *_listed(F.col("b"), F.col("b"))], ("a", "a_n", "b", "b_n"), strict=True)))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a × rows of b) number of first columns that agree."""
    same = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.int32)
    for x, y in zip(a.T, b.T, strict=True):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        length += same
    return length


def _reversed(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows read from their ends, padded behind."""
    wide = matrix.shape[1]
    out = matrix[:, ::-1].copy()
    short = lengths < wide
    out[short, :-1] = out[short, 1:]
    out[short, -1] = 32
    return out


def near_pairs(longer: int, side: str, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) of words one edit apart whose longer one has ``longer`` letters, by the side they share.

    Each pair of different words comes once: by its prefix where the first half agrees, else by its suffix.
    With b null, a pair within a comes once, as (lower, higher).
    """
    other = a if b is None else b
    lengths, others = (np.where(m[:, -1] == 32, longer - 1, longer) for m in (a, other))
    prefix = agreeing(a, other)
    half = (longer - 1) // 2
    wanted = (prefix >= half) if side == "prefix" else (prefix < half)
    wanted &= (lengths[:, None] == longer) | (others[None, :] == longer)
    if b is None:
        wanted &= np.tri(len(a), len(a), -1, dtype=bool).T
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix = agreeing(_reversed(a, lengths), _reversed(other, others))
    wanted &= (prefix.astype(np.int32) + suffix) >= longer - 1
    return np.nonzero(wanted)


def best_of(rows: np.ndarray, near: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, near word) pairs: rows, how many pairs each has, and its near word of largest n (ties: least order)."""
    by = np.lexsort((order[near], -n[near], rows))
    rows, near = rows[by], near[by]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.diff(np.r_[first, len(rows)]), near[first]


def _matrix(text: str, longer: int) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1"), np.uint8).reshape(-1, longer)


def compared(table: DataFrame) -> DataFrame:
    """(word, n_near, best): per tile, words with near words in it, how many, and the best as (least = -n, form)."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("least", pa.int64()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for longer, side, a, a_n, b, b_n in zip(*batch.columns, strict=True):
                longer, side, a, b = (x.as_py() for x in (longer, side, a, b))
                left = _matrix(a, longer)
                right = None if b is None else _matrix(b, longer)
                i, j = near_pairs(longer, side, left, right)
                if not len(i):
                    continue
                n = a_n.values.to_numpy()
                if right is None:
                    all_words = left
                else:
                    all_words, n, j = np.vstack([left, right]), np.r_[n, b_n.values.to_numpy()], j + len(left)
                names = np.ascontiguousarray(all_words).view(f"S{longer}").reshape(-1)
                order = np.empty(len(names), np.int64)
                order[np.argsort(names, kind="stable")] = np.arange(len(names))
                rows, times, near = best_of(np.r_[i, j], np.r_[j, i], n, order)
                spelt = [w.decode("latin-1").rstrip(" ") for w in names.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([spelt[r] for r in rows], pa.string()), pa.array(times, pa.int64()),
                                                  pa.array(-n[near], pa.int64()), pa.array([spelt[r] for r in near], pa.string())], schema=schema)

    return table.mapInArrow(run, "word string, n_near long, least long, form string")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form not null: forms are followed to the last, twice as far each round.

    A form occurs at least twice as often as its word, so there is no circle and chains are short.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(reached)
        reached = after.select("word", "root")
        if after.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all whole texts.

    Null and empty texts have no words; a null id stands as empty text in the rule that misspells runs. Repeated
    rows count each for itself; ties among near words go to the least in code-point order; an empty table
    gives no rows; other columns are not read. A text of any length is read in parts, and a word of any length is one row of its tile.
    """
    words = written(word_counts(docs, id_column, text_column), "words")
    found = compared(tiles(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", "form")).alias("best"))
    taken = -F.col("best.least") >= TIMES * F.col("n")
    told = written(words.join(found, "word", "left").select(
        "word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("best.least")).alias("form_n")), "variants")
    roots = rooted(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
