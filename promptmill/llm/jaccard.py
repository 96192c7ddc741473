"""Documents that share most of their word n-grams: MinHash values compared step by step, the rest exactly.

Texts with the same set of n-grams are one node. Bands of MinHash values put nodes that may be
similar into common buckets. In a bucket, pairs are compared a few values at a time and dropped as
soon as the posterior probability of reaching the threshold, given the matches so far, falls below
a tolerance. What survives says which nodes belong together; within these groups every pair is
then verified on the n-gram sets themselves. Large buckets and groups are cut into blocks by node
and compared block by block, and only counts and roots leave a task: never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promptmill.llm.common import mapped, mixed, named, word_names
from promptmill.llm.graphs import components
from promptmill.workspace import written

NGRAM = 5
THRESHOLD = Fraction(4, 5)
BANDS, BAND_VALUES = 32, 4
VALUES = BANDS * BAND_VALUES
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Nodes, and n-grams of sets, that a block aims at.
BLOCK_NODES, BLOCK_GRAMS = 1024, 500_000
#: Pairs of a block that are held at a time.
PAIRS = 1 << 16

_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(max(16, 2 * VALUES))], np.uint64)


def gram_sets(names: np.ndarray, at: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """The distinct n-grams of each text; a text of fewer than ``n`` words, but not of none, is one n-gram."""
    total = len(names)
    grams = np.zeros(max(0, total - n + 1), np.uint64)
    for j in range(n):
        grams += mixed(names[j:total - n + 1 + j] + _ODD[j]) * _ODD[j + 8]
    grams = mixed(grams)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo:hi - n + 1]))
        else:
            own = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                own = mixed(names[k:k + 1] + own * _ODD[3])
            out.append(own if hi > lo else own[:0])
    return out


def node_names(sets: list[np.ndarray]) -> list[bytes | None]:
    """128-bit names of sets; ``None`` for an empty one."""
    return [(int(mixed(s + _ODD[5]).sum(dtype=np.uint64)).to_bytes(8, "big")
             + int(mixed(s ^ _ODD[6]).sum(dtype=np.uint64)).to_bytes(8, "big")) if len(s) else None for s in sets]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets × VALUES, 32 bits) of sets, none of them empty."""
    if not sets:
        return np.zeros((0, VALUES), np.uint32)
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out, held = np.empty((VALUES, len(sets)), np.uint32), np.empty_like(x)
    for i in range(VALUES):
        np.multiply(x, np.uint32(int(mixed(_ODD[i:i + 1])[0]) & 0xFFFFFFFF | 1), out=held)
        held += np.uint32(int(mixed(_ODD[i + VALUES:i + VALUES + 1])[0]) & 0xFFFFFFFF)
        np.minimum.reduceat(held, starts, out=out[i])
    return np.ascontiguousarray(out.T)


def band_names(least: np.ndarray) -> np.ndarray:
    wide = least.reshape(len(least), BANDS, BAND_VALUES).astype(np.uint64)
    name = np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[1]
    for j in range(BAND_VALUES):
        name = mixed(name + wide[:, :, j])
    return name.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, row, node, n, values, bands) of every (doc_id, text, row, text_key); node and what follows null without words."""
    names = word_names()

    def piece(columns):
        ids, texts, rows, keys = columns
        _, flat, at = named(names, texts)
        sets = gram_sets(flat, at)
        full = [k for k, s in enumerate(sets) if len(s)]
        least = minima([sets[k] for k in full])
        values, bands = [None] * len(sets), [None] * len(sets)
        for k, own, band in zip(full, least.astype(np.uint16), band_names(least), strict=True):
            values[k], bands[k] = own.tobytes(), band
        return ids, keys, rows, node_names(sets), [len(s) for s in sets], values, bands

    return mapped(docs, piece, "doc_id long, text_key binary, row binary, node binary, n int, values binary, bands array<long>")


def required(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After so many compared values, the least matches that keep a pair.

    With a flat prior and m matches of n, similarity is Beta(m + 1, n - m + 1), and its upper tail at
    the threshold is a sum of binomial terms.
    """
    t, out = float(threshold), {}
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``count`` items' component under links a-b."""
    label = np.arange(count)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two blocks, or of one with itself, ``PAIRS`` at a time or a row at least."""
    rows = max(1, PAIRS // max(1, len(right)))
    for lo in range(0, len(left), rows):
        a, b = np.meshgrid(left[lo:lo + rows], right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        yield (a[a < b], b[a < b]) if same else (a, b)


def survivors(values: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, need: dict[int, int]):
    """Pairs that no step drops."""
    kept = []
    for a, b in _pairs(left, right, same):
        matches = np.zeros(len(a), np.int64)
        for n, least in need.items():
            part = slice(n - STEP, n)
            matches += (values[a, part] == values[b, part]).sum(1)
            stay = matches >= least
            a, b, matches = a[stay], b[stay], matches[stay]
            if not len(a):
                break
        else:
            kept.append((a, b))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: Fraction):
    """Pairs whose sets reach the threshold, exactly: shared n-grams are counted by products of 0/1 blocks."""
    sizes = np.array([len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = held > 1  # n-grams of one set only are never shared
    place = np.cumsum(often) - 1
    use = often[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for lo in range(0, int(often.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[row[i:j], column[i:j] - lo] = 1
        shared += block[left] @ block[right].T
    shared = shared.astype(np.int64)
    either = sizes[left][:, None] + sizes[right][None, :] - shared
    hit = shared * threshold.denominator >= threshold.numerator * either
    if same:
        hit &= left[:, None] < right[None, :]
    i, j = np.nonzero(hit)
    return left[i], right[j]


def _grouped(df: DataFrame, keys: int, work: Callable[[list, list[list]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on each group of equal leading ``keys`` columns; rows of a group must stand together in a partition."""
    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(target)

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        made = []
        for key, group in groupby(rows(), key=lambda r: r[:keys]):
            made += work(list(key), [list(c) for c in zip(*(r[keys:] for r in group), strict=True)])
            if len(made) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, target)


def _in_blocks(df: DataFrame, group: str, blocks) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in, pairs standing together."""
    own = F.expr("pmod(xxhash64(node), blocks)").cast("int")
    paired = (df.withColumn("blocks", blocks.cast("long")).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
              .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    return paired.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def _sides(i: int, j: int, own: list[int]):
    own = np.array(own)
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            threshold: Fraction = THRESHOLD, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_grams; with ``row`` (binary) also row and class_key.

    Linked are documents whose sets of 5-word n-grams (words: anything but ASCII white space) have a
    Jaccard similarity of ``threshold`` or more; ``n_links`` counts a document's linked others, copies
    included, and ``class_id`` is the least id among those it is connected to by links, its own if none.
    A text of one to four words is one n-gram of its own. Null and blank texts have no n-grams, no
    links, and a class each. Repeated rows count as documents. Null ids stay null and take the
    class of their copies. Other columns are ignored. ``class_key`` tells classes apart whatever their ids,
    and is null for a text without n-grams.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
                        (F.lit(None).cast("binary") if row is None else row).alias("row")).withColumn(
        "text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    sketch = written(sketches(plain), "sketches")
    nodes = written(
        sketch.where("node is not null").groupBy("node").agg(
            # The text that stands for a node: one of its least id (null only if all are), known by its md5 beside the id.
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("stands"),
            F.count("*").alias("copies"), F.first("n").alias("n"), F.first("values").alias("values"),
            F.first("bands").alias("bands")).select(
            "node", F.col("stands.doc_id").alias("least_id"), "stands.text_key", "copies", "n", "values", "bands"), "nodes")

    # Buckets of the same nodes are one.
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = (banded.groupBy("band").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"),
                                          F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
               .where("m > 1").groupBy("m", "x", "y").agg(F.min("band").alias("band")).select("band", "m"))
    members = banded.join(buckets, "band").join(nodes.select("node", "values"), "node")
    need = required(threshold)

    def compare(key, columns):
        _, i, j = key
        own, node, values = columns
        left, right, same = _sides(i, j, own)
        at = np.frombuffer(b"".join(values), np.uint16).reshape(len(node), VALUES)
        root = roots(len(node), *survivors(at, left, right, same, need))
        return [(node[k], node[r]) for k, r in enumerate(root.tolist()) if r != k]

    likely = _grouped(_in_blocks(members, "band", F.ceil(F.col("m") / BLOCK_NODES)).select(
        "band", "i", "j", "own", "node", "values"), 3, compare, "a binary, b binary")
    groups = components(written(likely.distinct(), "likely"))

    sizes = groups.join(nodes.select("node", "n"), "node").groupBy("component").agg(
        F.count("*").alias("m"), F.sum("n").alias("grams"))
    wanted = (groups.join(sizes, "component").join(nodes.select("node", "least_id", "text_key", "copies"), "node"))
    names = word_names()

    def grams(columns):
        node, text, *rest = columns
        _, flat, at = named(names, text)
        sets = gram_sets(flat, at)
        # Of a row that is repeated once is enough.
        right = list({name: k for k, name in enumerate(node)}.values())
        return [[node[k] for k in right], [sets[k].tobytes() for k in right]] + [[c[k] for k in right] for c in rest]

    held = mapped(
        wanted.join(plain, (wanted.text_key == plain.text_key) & F.col("least_id").eqNullSafe(F.col("doc_id"))).select("node", "text", "component", "m", "grams", "copies"),
        grams, "node binary, grams binary, component binary, m long, total long, copies long")

    def verify(key, columns):
        _, i, j = key
        own, node, grams, copies = columns
        keep = [k for k, name in enumerate(node) if k == 0 or name != node[k - 1]]  # repeated rows
        own, node, grams, copies = ([c[k] for k in keep] for c in (own, node, grams, copies))
        left, right, same = _sides(i, j, own)
        a, b = verified([np.frombuffer(g, np.uint64) for g in grams], left, right, same, threshold)
        copies = np.array(copies)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = roots(len(node), a, b)
        return [(node[k], node[r], n) for k, (r, n) in enumerate(zip(root.tolist(), links.tolist(), strict=True)) if n]

    linked = written(_grouped(_in_blocks(held, "component", F.greatest(
        F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_GRAMS))).select(
        "component", "i", "j", "own", "node", "grams", "copies"), 3, verify, "a binary, b binary, links long"), "linked")
    counts = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(linked.select("a", "b"))
    least = (classes.join(nodes.select("node", "least_id"), "node").groupBy("component")
             .agg(F.min("least_id").alias("class_id")))
    told = (nodes.select("node", "least_id", "copies").join(counts, "node", "left")
            .join(classes.join(least, "component").select("node", "class_id", F.col("component").alias("class_key")), "node", "left")
            .select("node", F.coalesce("class_key", "node").alias("class_key"), F.coalesce("class_id", "least_id").alias("class_id"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sketch.select("doc_id", "row", "node", "n").join(told, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n").alias("n_grams"), *(["row", "class_key"] if row is not None else []))
