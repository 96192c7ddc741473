"""What the operators share: reading columns of Arrow batches in bounded pieces, word names, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task works on at a time (one longer text makes a piece of its own).
PIECE_BYTES = 1 << 19
#: Entries of a task's memo of words; beyond it words are computed anew, never dropped.
MEMO_ENTRIES = 200_000


def mapped(df: DataFrame, piece: Callable[[list[list]], Iterable[tuple]], schema: str | StructType,
           weigh: int = 1) -> DataFrame:
    """Run ``piece`` over columns of rows, some ``PIECE_BYTES`` of column ``weigh`` at a time.

    ``piece`` gets one list per column (strings as UTF-8 bytes, null as ``None``) and returns one
    list or array per output column. Columns are passed by position, so clashing names do no harm.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        for batch in batches:
            columns = [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
                       else c.to_pylist() for c in batch.columns]
            sizes = [len(v) if v is not None else 0 for v in columns[weigh]]
            for lo, hi in pieces(sizes):
                made = piece([c[lo:hi] for c in columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``PIECE_BYTES`` in all, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > PIECE_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Memo(dict):
    """``make`` of a key, remembered for the first ``entries`` short keys."""

    def __init__(self, make: Callable, entries: int | None = None):
        super().__init__()
        self.make, self.entries = make, MEMO_ENTRIES if entries is None else entries

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.entries and len(key) <= 64:
            self[key] = value
        return value


def word_names() -> Memo:
    """64-bit names of words (bytes)."""
    import xxhash
    return Memo(xxhash.xxh3_64_intdigest)


def named(names: Memo, texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text (runs of anything but ASCII white space), all names, and where each text begins."""
    words = [t.split() if t else [] for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    flat = np.fromiter((names[w] for ws in words for w in ws), np.uint64, int(at[-1]))
    return words, flat, at


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
