"""Exact k-means over integer vectors by subvector dictionaries.

Vectors are packed once into chunks. Within a chunk every block of ``width`` dimensions is dictionary-encoded:
its distinct subvectors, and one code a vector. A round computes the squared distance of every distinct
subvector to every centroid once, and a vector's distance is the sum of its codes' partial distances. All
of it is integer arithmetic, so nothing is rounded. Chunks are a written table; what a round brings to the
driver is one row a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.workspace import written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Dimensions of a block, and vectors of a chunk (codes are 16 bits wide).
WIDTH, CHUNK = 2, 1 << 15
#: Components beyond this magnitude are refused: a squared distance over them might not fit a long.
MOST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """Final centroids in order of their numbers, and what each cluster holds."""

    centroids: list[list[int]]
    sizes: list[int]
    inertia: list[int]


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True where a vector has exactly ``dimensions`` components, all of them finite numbers; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(SCALE)).cast("long"))


def vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, e): usable vectors as whole numbers; every row for itself, null ids stay null, other columns are not read."""
    v = F.col(vector_column)
    return table.where(usable(v)).select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(v).alias("e"))


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 3) -> list[list[int]]:
    """The first vectors by the sha256 of ``<seed>:<vec_id>`` (null ids last, ties by components)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["e"] for r in rows.select(name.alias("name"), "e").orderBy(F.asc_nulls_last("name"), "e").limit(clusters).collect()]


def encoded_chunk(rows: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct subvectors of all blocks one after the other, how many each block has, codes (blocks × vectors)."""
    entries, sizes, codes = [], [], []
    for lo in range(0, rows.shape[1], width):
        block = rows[:, lo:lo + width]
        code = np.zeros(len(block), np.int64)
        # One dimension after the other: a pair of codes is told apart by one number below CHUNK squared.
        for column in block.T:
            values, at = np.unique(column, return_inverse=True)
            code = np.unique(code * len(values) + at.reshape(-1), return_inverse=True)[1].reshape(-1)
        first = np.zeros(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        entries.append(block[first].reshape(-1))
        sizes.append(len(first))
        codes.append(code.astype(np.uint16))
    return np.concatenate(entries), np.array(sizes, np.int32), np.stack(codes)


def chunks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Written table of chunks: (ids, entries, sizes, codes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
            if len(flat) and max(abs(int(flat.min())), abs(int(flat.max()))) > MOST:
                raise OverflowError(f"a component times {SCALE} is beyond {MOST}")
            entries, sizes, codes = encoded_chunk(flat.reshape(len(ids), -1), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([entries], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())],
                names=["ids", "entries", "sizes", "codes"])

        def emptied() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return out(table.column(0).combine_chunks(), table.column(1).combine_chunks().flatten().to_numpy())

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == CHUNK:
                    yield emptied()
                    n = 0
        if n:
            yield emptied()

    return written(rows.select("vec_id", "e").mapInArrow(run, "ids array<long>, entries array<long>, sizes array<int>, codes binary"), "chunks")


def _blocks(row: dict, width: int, dimensions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of each block of a chunk."""
    entries, at = np.asarray(row["entries"], np.int64), 0
    codes = np.frombuffer(row["codes"], np.uint16).reshape(len(row["sizes"]), -1)
    for b, size in enumerate(row["sizes"]):
        wide = min(width, dimensions - b * width)
        yield b * width, entries[at:at + size * wide].reshape(size, wide), codes[b]
        at += size * wide


def distances(row: dict, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(vectors × centroids) squared distances of a chunk, by partial distances of codes."""
    total = np.zeros((len(row["ids"]), len(centroids)), np.int64)
    for lo, entries, codes in _blocks(row, width, centroids.shape[1]):
        apart = entries[:, None, :] - centroids[None, :, lo:lo + entries.shape[1]]
        total += (apart * apart).sum(2)[codes]
    return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: (column[k].as_py() if name == "codes" else column[k].values.to_numpy(zero_copy_only=False)
                          if name != "ids" else column[k].values) for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def gathered(table: DataFrame, centroids: list[list[int]], width: int = WIDTH) -> list[dict]:
    """Of each cluster that has vectors: their number, componentwise sums, and summed distance."""
    fixed, dimensions = np.array(centroids, np.int64), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fixed)
        for row in _rows(batches):
            apart = distances(row, fixed, width)
            nearest = apart.argmin(1)  # the first, so the smaller number, of equal ones
            sums = np.zeros((k, dimensions), np.int64)
            for lo, entries, codes in _blocks(row, width, dimensions):
                times = np.bincount(codes.astype(np.int64) * k + nearest, minlength=len(entries) * k).reshape(len(entries), k)
                sums[:, lo:lo + entries.shape[1]] = times.T @ entries
            inertia = np.zeros(k, np.int64)
            np.add.at(inertia, nearest, apart[np.arange(len(nearest)), nearest])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array(np.bincount(nearest, minlength=k), pa.int64()),
                 pa.array(list(sums), pa.list_(pa.int64())), pa.array(inertia, pa.int64())], names=["cluster", "n", "sums", "inertia"])

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>, inertia long").where("n > 0")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(dimensions))).alias("sums"),
                                          F.sum("inertia").alias("inertia"))
    return [r.asDict() for r in summed.collect()]


def clustered(table: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, width: int = WIDTH) -> Clustering:
    """Move ``centroids`` for ``rounds`` rounds over a table of :func:`chunks`, then assign once more.

    Rounds end early only where no centroid moves, after which none ever would.
    """
    for _ in range(rounds):
        moved = list(centroids)
        for r in gathered(table, centroids, width):
            moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        if moved == centroids:
            break
        centroids = moved
    sizes, inertia = [0] * len(centroids), [0] * len(centroids)
    for r in gathered(table, centroids, width):
        sizes[r["cluster"]], inertia[r["cluster"]] = r["n"], r["inertia"]
    return Clustering(centroids, sizes, inertia)


def assigned(table: DataFrame, found: Clustering, width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of a table of :func:`chunks`."""
    fixed = np.array(found.centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            apart = distances(row, fixed, width)
            nearest = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(nearest, pa.int32()), pa.array(apart[np.arange(len(nearest)), nearest], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(table: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH,
             id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors that are null, of another length, or hold a null, NaN or infinite component take no part. Ties
    in distance go to the smaller cluster number. Repeated rows, also of one id, count each for itself; a null
    id stays null and is never preferred as a first centroid. Fewer vectors than ``count`` give as many clusters;
    an empty table gives no rows. Other columns are not read. A component beyond 2^27 / 1024 in magnitude is an error,
    since distances are longs.
    """
    rows = vectors(table, id_column, vector_column)
    first = seeds(rows, count)
    if not first:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    packed = chunks(rows, width)
    found = clustered(packed, first, rounds, width)
    names = F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in found.centroids))
    return assigned(packed, found, width).select(
        "vec_id", "cluster", "distance", F.get(F.array(*map(F.lit, found.inertia)), F.col("cluster")).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
