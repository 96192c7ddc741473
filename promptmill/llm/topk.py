"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Vectors stand in blocks. In a block every dimension is a list of (value, vector) sorted by value, read from the top
for a positive query component and from the bottom for a negative one, in rising steps. Each vector has a lower bound
(what was read of it plus the least that its other lists can give) and an upper bound (what was read plus what these lists
can still give); one that was never read has the bound of the place reached. Vectors whose upper bound is below the
k-th lower bound are out. Reading stops when no more than k are left, and these get their scores. The blocks'
winners meet per query. Bounds are whole numbers, so nothing is out by rounding.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Vectors of a block, and queries that meet it at a time.
BLOCK, QUERIES = 4096, 2048
#: Entries of each list that are read first; from then on as many again as were read before.
FIRST_STEP = 16


def scaled(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(column: str) -> Column:
    """Not null, not empty, and no component null or not finite."""
    return (F.col(column).isNotNull() & (F.size(column) > 0)
            & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))


class Lists:
    """A block's vectors with a list of (value, vector) for each dimension, sorted upwards by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        across = np.ascontiguousarray(self.vectors.T)
        order = np.argsort(across, axis=1, kind="stable")
        self.whole = np.take_along_axis(across, order, axis=1)
        self.values, self.order = self.whole.astype(np.float64), order
        self.place = np.empty(vectors.shape, np.int32)  # where in each list a vector stands
        self.place[order, np.arange(vectors.shape[1])[:, None]] = np.arange(len(ids), dtype=np.int32)
        self.entries_read = 0  # of all lists, by all queries so far

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best but ``own``, ties to the smaller id."""
        n, top, bottom = len(self.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        dims = np.concatenate([top, bottom])
        active = np.flatnonzero(self.ids != own)
        # Sums of doubles are exact below 2^53; larger scores are added up as longs.
        widest = np.abs(query.astype(float)) @ np.abs(self.values[:, [0, -1]]).max(1)
        number, values = (np.float64, self.values) if widest < 2**51 else (np.int64, self.whole)
        weight = query[dims].astype(number)[:, None]
        least = weight * np.concatenate([values[top, :1], values[bottom, -1:]])
        lower, depth, step = np.full(n, least.sum(), number), 0, max(k, FIRST_STEP)
        while len(active) > k and depth < n and len(dims):
            to = min(n, depth + step)
            row = np.concatenate([self.order[top, n - to:n - depth], self.order[bottom, depth:to]])
            gain = np.concatenate([values[top, n - to:n - depth], values[bottom, depth:to]]) * weight - least
            if number is np.float64:
                lower += np.bincount(row.ravel(), gain.ravel(), n)
            else:
                np.add.at(lower, row.ravel(), gain.ravel())
            self.entries_read += row.size
            # At most this much comes from a list where a vector has not been read.
            rest = np.concatenate([gain[:len(top), 0], gain[len(top):, -1]])
            bound = lower[active]
            kth = np.partition(bound, len(bound) - k)[len(bound) - k]
            # Upper bounds are worth drawing once one that was never read, or the average one, does not reach the k-th.
            if to < n and min(least.sum() + rest.sum(), bound.mean() + rest.sum() * (1 - to / n)) < kth:
                at = self.place[active]
                read = np.concatenate([at[:, top] >= n - to, at[:, bottom] < to], axis=1)
                active = active[bound + (rest.sum() - read.astype(number) @ rest) >= kth]
            elif to == n:
                active = active[bound >= kth]  # all is read: bounds are scores
            depth, step = to, to
        score = self.vectors[active] @ query
        first = np.lexsort((self.ids[active], -score))[:k]
        return self.ids[active][first], score[first]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows.

    ``queries`` picks the rows that ask; every usable row with another id answers, ties to the smaller
    id. Vectors that are null, empty, or hold a null or non-finite component take no part; vectors of different
    lengths do not meet; rows without an id take no part; a row repeated with the same vector
    counts once. Two vectors of one id both ask and both answer others, but not each other. Scores must fit a long;
    vectors may be of any length. Other columns are never read.
    """
    rows = (vectors.where(usable(vector_column) & F.col(id_column).isNotNull())
            .select(F.col(id_column).cast("long").alias("id"), scaled(vector_column).alias("v"), queries.alias("asks")).distinct())
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, groups = max(1, -(-sizes.n // BLOCK)), max(1, -(-sizes.q // QUERIES))
    dims = F.size("v").alias("dims")
    answers = rows.select(dims, F.expr(f"pmod(xxhash64(id), {blocks})").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("group"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where("asks").select(dims, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"),
                                      F.expr(f"pmod(xxhash64(id), {groups})").alias("group"), F.lit(True).alias("asks"), "id", "v")
    target = StructType.fromDDL("query_id long, vec_id long, score long")

    def search(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(target)

        def told():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, group in groupby(told(), key=lambda r: r[:3]):
            ids, held, lists, out = [], [], None, []
            for _, _, _, asks, id_, v in group:  # a block's vectors stand before its queries
                if not asks:
                    ids.append(id_)
                    held.append(v)
                    continue
                if not ids:
                    continue
                if lists is None:
                    lists = Lists(np.array(ids, np.int64), np.array(held, np.int64))
                found, score = lists.best(np.array(v, np.int64), id_, k)
                out += [(id_, a, b) for a, b in zip(found.tolist(), score.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    met = (answers.unionByName(asked).repartition("dims", "block", "group")
           .sortWithinPartitions("dims", "block", "group", "asks").mapInArrow(search, target))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
