"""Language identification by interpolated Kneser-Ney character models.

For every language, characters of a word are predicted from up to ``ORDER - 1`` characters before them.
Spark counts the grams of all training texts. The model is stored in sorted hash arrays: grams of one language
whose contexts end in the same two characters make a row of sorted 64-bit names with their shares, and of
contexts with their back-off weights, order by order. Every gram has an entry of its own. The distinct grams of the texts to
score are dealt by the same two characters and looked up by binary search, each row of arrays for itself, so
neither driver nor task holds the model. What the last character of a gram costs is a whole number of
2^-24 bits, so sums over a text do not depend on their order. Scoring tasks hold the most frequent grams
as one sorted array; costs of the others are joined. The language of the lowest
cross-entropy per character is chosen; confidence and rejection are calibrated.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promptmill.llm.common import fold_of, mapped, mixed, pieces
from promptmill.workspace import dropped, written

ORDER = 5
#: Distinct words, and grams, that a counting task holds before it hands them on (they are summed again afterwards).
HELD_WORDS, HELD_GRAMS = 100_000, 200_000
#: Values (grams by languages) of the most frequent grams that every scoring task holds; the other grams are joined.
HELD_VALUES = 1 << 20
#: Words whose costs a scoring task remembers; others are added up anew.
MEMO_WORDS = 200_000
#: Sharpnesses of confidence to choose from.
SHARPNESSES = [2.0 ** e for e in range(-2, 7)]
#: One text in so many is left out of the counts; confidence is calibrated on all of these.
LEFT_OUT = 64
#: Share of the calibration texts whose cross-entropy is rejected.
REJECTED_SHARE = 0.001
UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
#: Steps of a cost in a bit.
STEPS = 1 << 24
_LETTERS = regex.compile(r"\p{L}+")
#: Spaces for what is no letter among the ASCII characters.
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_RUNS = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x02", "\x03"
#: What each character before the end of a gram is multiplied by in the gram's name.
_FACTORS = mixed(np.arange(1, ORDER + 1, dtype=np.uint64))


def words_of(text: bytes | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    # Lower-cased before anything is cut, as a letter's form may depend on what stands around it.
    runs = text.decode().lower().encode().translate(_SPACED).decode().split()
    # A run may hold characters beyond ASCII that are no letters; joined runs are letters just where each one is.
    return runs if "".join(runs).isalpha() else [
        w for r in runs for part in ((r,) if r.isalpha() else _RUNS.findall(r)) for w in ((part,) if part.isalpha() else _LETTERS.findall(part))]


def grams_of(word: str) -> list[str]:
    padded = _BEGIN * (ORDER - 1) + word + _END
    return [padded[i:i + ORDER] for i in range(len(word) + 1)]


def _windows(words: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Padded words in one text, its code points, how many grams each word has and where every gram begins."""
    padded = _BEGIN * (ORDER - 1) + (_END + _BEGIN * (ORDER - 1)).join(words) + _END
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words])
    # Windows that start before a word's end belong to it, those within the padding to none.
    begins = np.r_[0, np.cumsum(sizes + ORDER - 1)[:-1]]
    return padded, codes, sizes, np.arange(sizes.sum()) + np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def counted(words: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Grams of words that occur so often, each with its count; a gram may come several times."""
    listed, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    for lo, hi in pieces(list(map(len, listed))):
        padded, codes, sizes, begins = _windows(listed[lo:hi])
        used = np.zeros(int(codes.max()) + 1, bool)
        used[codes] = True
        bits = int(used.sum()).bit_length()
        if bits * ORDER > 64:
            # Too many different characters for a number to hold a gram.
            yield from ((gram, n) for word, n in zip(listed[lo:hi], times[lo:hi].tolist(), strict=True) for gram in grams_of(word))
            continue
        dense, packed = (np.cumsum(used) - 1).astype(np.uint64)[codes], np.zeros(len(begins), np.uint64)
        for k in range(ORDER):
            packed = (packed << np.uint64(bits)) | dense[begins + k]
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, inverse, np.repeat(times[lo:hi], sizes))
        yield from zip((padded[i:i + ORDER] for i in begins[first].tolist()), totals.tolist(), strict=True)


def codes_of(grams: list[str]) -> np.ndarray:
    """Code points of grams of one length, a row a gram."""
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), -1).astype(np.uint64)


def names(codes: np.ndarray) -> np.ndarray:
    """64-bit names of rows of code points, counted from their ends."""
    total = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        total += codes[:, -1 - k] * _FACTORS[k]
    return mixed(total)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over every (lang, text); a text counts once for an empty gram too, so that no language is lost."""
    target = StructType.fromDDL("lang string, gram string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(target)
        words: dict[str | None, Counter] = defaultdict(Counter)
        grams: dict[str | None, Counter] = defaultdict(Counter)

        def cut() -> None:
            for lang, counts in words.items():
                held = grams[lang]
                for gram, n in counted(counts):
                    held[gram] += n
            words.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in grams.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], schema=schema)
            grams.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for lang, text in zip(langs, texts, strict=True):
                words[lang].update(words_of(text.as_py()))
                grams[lang][""] += 1
                if sum(map(len, words.values())) >= HELD_WORDS:
                    cut()
                    if sum(map(len, grams.values())) >= HELD_GRAMS:
                        yield from out()
        cut()
        yield from out()

    return docs.mapInArrow(run, target).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels_of(counts: DataFrame) -> dict[int, DataFrame]:
    """For each order (lang, gram, c): how often a gram of the highest order occurs, and how many letters a shorter one continues."""
    levels = {ORDER: counts.where("lang is not null and gram <> ''").select("lang", "gram", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"grams_{k}")
    return levels


def discounts(levels: dict[int, DataFrame]) -> dict[tuple[str, int], float]:
    """What is taken off every count, by language and order: one row each."""
    ones = [level.groupBy("lang").agg(F.lit(k).alias("k"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
            for k, level in levels.items()]
    rows = ones[0]
    for more in ones[1:]:
        rows = rows.unionByName(more)
    return {(r["lang"], r["k"]): min(0.95, max(0.05, r["n1"] / (r["n1"] + 2.0 * r["n2"] + 1e-9))) for r in rows.collect()}


def _by_language(rows: DataFrame, langs: list[str], *values: str) -> DataFrame:
    """(gram, one array a value with an entry a language, null where it has none) of (lang, gram, *values)."""
    listed = rows.groupBy("gram").agg(F.collect_list(F.struct("lang", *values)).alias("told"))
    every = F.transform(F.array(*map(F.lit, langs)), lambda lang: F.get(F.filter("told", lambda t: t["lang"] == lang), F.lit(0)))
    return listed.select("gram", every.alias("told")).select("gram", *(F.col("told")[v].alias(v) for v in values))


def _shares(level: DataFrame, k: int, langs: list[str], off: dict[tuple[str, int], float]) -> tuple[DataFrame, DataFrame]:
    """(gram, own) of an order's grams and (gram, backoff) of their contexts, by language. Meant for the lowest orders."""
    d = F.create_map(*(F.lit(x) for lang in langs for x in (lang, off.get((lang, k), 0.5))))[F.col("lang")]
    contexts = (level.groupBy("lang", F.substring("gram", 1, k - 1).alias("context"))
                .agg(F.sum("c").alias("t"), F.count("*").alias("types"), F.collect_list(F.struct("gram", "c")).alias("grams")))
    own = contexts.select("lang", "t", F.explode("grams").alias("g")).select("lang", "g.gram", ((F.col("g.c") - d) / F.col("t")).alias("own"))
    backoff = contexts.select("lang", F.col("context").alias("gram"), (d * F.col("types") / F.col("t")).alias("backoff"))
    return _by_language(own, langs, "own"), _by_language(backoff, langs, "backoff")


def packed(levels: dict[int, DataFrame], langs: list[str], off: dict[tuple[str, int], float]) -> DataFrame:
    """(ends, lang, grams, own, contexts, backoff): for orders 3 and up, sorted names with their values as bytes.

    ``ends`` is the last two characters of the context; ``lang`` is a place in ``langs``.
    """
    place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    rows = None
    for k in range(3, ORDER + 1):
        more = levels[k].select(place.alias("lang"), F.substring("gram", k - 2, 2).alias("ends"), F.struct(F.lit(k).alias("k"), "gram", "c").alias("g"))
        rows = more if rows is None else rows.unionByName(more)
    schema = "ends string, lang int, grams array<binary>, own array<binary>, contexts array<binary>, backoff array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ends, lang, listed in zip(*batch.columns, strict=True):
                lang, listed = lang.as_py(), listed.values
                order, grams, counts = listed.field("k").to_numpy(), listed.field("gram"), listed.field("c").to_numpy()
                out: list[list[bytes]] = [[], [], [], []]
                for k in range(3, ORDER + 1):
                    at = np.flatnonzero(order == k)
                    if not len(at):
                        for o in out:
                            o.append(b"")
                        continue
                    codes, c, d = codes_of(grams.take(pa.array(at)).to_pylist()), counts[at].astype(float), off[langs[lang], k]
                    contexts, inverse = np.unique(names(codes[:, :-1]), return_inverse=True)
                    total, kinds = np.bincount(inverse, c), np.bincount(inverse)
                    named, own = names(codes), (c - d) / total[inverse]
                    by = np.argsort(named)
                    for o, values in zip(out, (named[by], own[by], contexts, d * kinds / total), strict=True):
                        o.append(values.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([ends.as_py()]), pa.array([lang], pa.int32()), *(pa.array([o], pa.list_(pa.binary())) for o in out)],
                                                 names=["ends", "lang", "grams", "own", "contexts", "backoff"])

    return rows.groupBy("ends", "lang").agg(F.collect_list("g").alias("g")).select("ends", "lang", "g").mapInArrow(run, schema)


def found(sought: np.ndarray, sorted_names: bytes, values: bytes, missing: float) -> np.ndarray:
    """Values of names by binary search in a sorted array."""
    held, told = np.frombuffer(sorted_names, np.uint64), np.frombuffer(values, np.float64)
    if not len(held):
        return np.full(len(sought), missing)
    at = np.minimum(np.searchsorted(held, sought), len(held) - 1)
    return np.where(held[at] == sought, told[at], missing)


@dataclass
class Spelled:
    """Costs of grams: the table (name, n, costs), its most frequent grams as a sorted array, and whether there are others."""

    table: DataFrame
    names: np.ndarray
    costs: np.ndarray
    others: bool


@dataclass
class Model:
    """Languages, the written tables of their grams, and how sure a text's costs make."""

    langs: list[str]
    #: (gram, own) of single characters and of pairs, (gram, backoff) of single characters, and the sorted arrays.
    ones: DataFrame | None = None
    twos: DataFrame | None = None
    weights: DataFrame | None = None
    arrays: DataFrame | None = None
    #: What each language leaves to the uniform share where nothing stands before a letter.
    left: list[float] | None = None
    uniform: float = 1 / 256
    sharpness: float = 12.0
    limit: float = 1e9

    def looked_up(self, grams: DataFrame) -> DataFrame:
        """(name, n, costs) of distinct (gram, n) of the highest order: what their last character costs in each language.

        Order by order, a gram's share is its own one and what its context leaves of the share of the gram
        without its first character. An unknown context leaves everything.
        """
        width, floor = len(self.langs), F.array(*(F.lit(left * self.uniform) for left in self.left))
        every = f"sequence(0, {width - 1})"
        needed = grams.select(F.substring("gram", 4, 2).alias("gram")).distinct().select("gram", F.substring("gram", 1, 1).alias("before"), F.substring("gram", 2, 1).alias("last"))
        pairs = (needed.join(self.ones.select(F.col("gram").alias("last"), F.col("own").alias("one")), "last", "left").join(self.twos, "gram", "left")
                 .join(self.weights.select(F.col("gram").alias("before"), "backoff"), "before", "left").withColumn("floor", floor)
                 .select("gram", F.expr(f"transform({every}, i -> coalesce(own[i], 0D) + coalesce(backoff[i], 1D) * (coalesce(one[i], 0D) + floor[i]))").alias("p")))
        pairs = written(pairs, "pairs")
        dealt = (grams.select("gram", "n", F.substring("gram", 4, 2).alias("pair")).join(pairs.select(F.col("gram").alias("pair"), "p"), "pair")
                 .groupBy(F.substring("gram", 3, 2).alias("ends")).agg(F.collect_list(F.struct("gram", "n", "p")).alias("sought")))
        arrays = self.arrays.groupBy("ends").agg(F.collect_list(F.struct("lang", "grams", "own", "contexts", "backoff")).alias("held"))
        told = dealt.join(arrays, "ends", "left").select("sought", "held")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sought, held in zip(*batch.columns, strict=True):
                    sought = sought.values
                    codes = codes_of(sought.field("gram").to_pylist())
                    p = sought.field("p").flatten().to_numpy().reshape(-1, width).copy()
                    tables = held.as_py() or []
                    for k in range(3, ORDER + 1):
                        named, contexts = names(codes[:, ORDER - k:]), names(codes[:, ORDER - k:-1])
                        for t in tables:
                            p[:, t["lang"]] *= found(contexts, t["contexts"][k - 3], t["backoff"][k - 3], 1.0)
                            p[:, t["lang"]] += found(named, t["grams"][k - 3], t["own"][k - 3], 0.0)
                    costs = np.rint(-np.log2(np.maximum(p, 1e-12)) * STEPS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names(codes).view(np.int64)), sought.field("n"), pa.array(list(costs), pa.list_(pa.int64()))],
                                                     names=["name", "n", "costs"])

        return told.mapInArrow(run, "name long, n long, costs array<long>")

    def bits(self, grams: list[str]) -> np.ndarray:
        """(grams × languages) bits that the last character of each gram costs."""
        asked = self.arrays.sparkSession.createDataFrame([(g, 1) for g in dict.fromkeys(grams)], "gram string, n long")
        got = {r["name"]: r["costs"] for r in self.looked_up(asked).collect()}
        return np.array([got[int(n)] for n in names(codes_of(grams)).view(np.int64)]).reshape(len(grams), len(self.langs)) / STEPS

    def spelled(self, counts: DataFrame) -> Spelled:
        """Costs of every distinct gram of (gram, n)."""
        listed = counts.where("gram <> ''").groupBy("gram").agg(F.sum("n").alias("n"))
        if not self.langs:
            return Spelled(listed.selectExpr("0L as name", "n", "cast(array() as array<long>) as costs"), np.zeros(0, np.uint64), np.zeros((0, 0), np.int64), False)
        table = written(self.looked_up(listed), "gram_costs")
        most = max(1, HELD_VALUES // len(self.langs))
        held = table.orderBy(F.desc("n"), "name").limit(most).select("name", "costs").toArrow().combine_chunks()
        named = held["name"].combine_chunks().to_numpy().view(np.uint64) if len(held) else np.zeros(0, np.uint64)
        costs = held["costs"].combine_chunks().flatten().to_numpy().reshape(len(named), len(self.langs)) if len(held) else np.zeros((0, len(self.langs)), np.int64)
        by = np.argsort(named)
        return Spelled(table, named[by], costs[by].astype(np.int32), table.count() > len(named))

    def predict(self, total: np.ndarray):
        """(language, score, rejected, bits per character) of each row of costs under each language and characters."""
        n = len(total)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n), [True] * n, np.zeros(n)
        bits, size = bits_of(total)
        best = bits.argmin(1)
        least = bits[np.arange(n), best]
        weight = np.exp2(-self.sharpness * (bits - least[:, None]))
        rejected = (size == 0) | (least > self.limit)
        score = np.where(size == 0, 0.0, 1 / weight.sum(1)) * np.where(rejected, 0.5, 1.0)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, size, strict=True)], score, rejected.tolist(), least


def bits_of(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character under each language, and characters, of rows of costs and characters."""
    size = total[:, -1]
    return total[:, :-1] / STEPS / np.maximum(size, 1)[:, None], size


class Words:
    """Costs of words from the held grams, and names of their grams that are not held."""

    def __init__(self, named: np.ndarray, costs: np.ndarray):
        self.named, self.costs = named, costs
        self.places: dict[str, int] = {}
        self.table = np.zeros((MEMO_WORDS, costs.shape[1] + 1), np.int64)
        self.others: dict[str, np.ndarray] = {}

    def added(self, words: list[str]) -> np.ndarray:
        """Costs and characters (with the end) of each word; names of grams that are not held go to ``others``."""
        _, codes, sizes, inside = _windows(words)
        sums = np.zeros(len(codes) - ORDER + 1, np.uint64)
        for k in range(ORDER):
            sums += codes[ORDER - 1 - k:len(codes) - k] * _FACTORS[k]
        sought = mixed(sums[inside])
        at = np.minimum(np.searchsorted(self.named, sought), max(len(self.named) - 1, 0))
        known = self.named[at] == sought if len(self.named) else np.zeros(len(sought), bool)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        costs = np.where(known[:, None], self.costs[at], 0) if len(self.named) else np.zeros((len(sought), self.costs.shape[1]), np.int64)
        out = np.column_stack([np.add.reduceat(costs.astype(np.int64), starts), sizes])
        if not known.all():
            for i in np.unique(np.searchsorted(starts, np.flatnonzero(~known), "right") - 1):
                mine = slice(starts[i], starts[i] + sizes[i])
                self.others[words[i]] = sought[mine][~known[mine]].view(np.int64)
        return out

    def totals(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[Counter]]:
        """Of texts, costs of the held grams under each language and characters, and counts of the other grams."""
        lists, places = [words_of(t) for t in texts], self.places
        new = [w for w in set().union(*lists) if w not in places]
        rows = self.added(new) if new else self.table[:0]
        # What is remembered comes first in the table, the rest of this piece behind it.
        room = min(len(new), len(self.table) - len(places))
        for k, w in enumerate(new[:room]):
            places[w] = len(places)
            self.table[places[w]] = rows[k]
        table = self.table
        if room < len(new):
            table = np.vstack([self.table, rows[room:]])
            places.update((w, len(self.table) + k) for k, w in enumerate(new[room:]))
        total, others = np.zeros((len(texts), self.table.shape[1]), np.int64), []
        for i, ws in enumerate(lists):
            total[i] = table[np.fromiter(map(places.__getitem__, ws), np.int64, len(ws))].sum(0)
            said: Counter = Counter()
            if self.others:
                for w in filter(self.others.__contains__, ws):
                    said.update(self.others[w].tolist())
            others.append(said)
        for w in new[room:]:
            del places[w]
            self.others.pop(w, None)
        return total, others


def _summed(spelled: Spelled):
    named, costs, held = spelled.names, spelled.costs, []

    def run(texts: list[bytes | None]) -> tuple[np.ndarray, list[Counter]]:
        if not held:
            held.append(Words(named, costs))
        return held[0].totals(texts)

    return run


def totals(rows: DataFrame, spelled: Spelled) -> DataFrame:
    """(key, total) of every (key, text): costs under each language, then characters. Grams that no task holds are joined."""
    kind, summed = rows.schema[0].dataType.simpleString(), _summed(spelled)

    def piece(columns):
        keys, texts = columns
        total, others = summed(texts)
        # A row that has other grams is known by a number of its own once it is written.
        return (keys, total.tolist(), [uuid.uuid4().bytes if c else None for c in others], [list(c) for c in others], [list(c.values()) for c in others])

    out = mapped(rows, piece, f"key {kind}, total array<long>, row binary, names array<long>, times array<long>")
    if not spelled.others:
        return out.select("key", "total")
    out, width = written(out, "texts_read"), spelled.costs.shape[1]
    said = out.where("row is not null").select("row", F.explode(F.arrays_zip("names", "times")).alias("w")).select("row", F.col("w.names").alias("name"), "w.times")
    more = (said.join(spelled.table.select("name", "costs"), "name").groupBy("row")
            .agg(*(F.sum(F.col("times") * F.col("costs")[j]).alias(f"_{j}") for j in range(width)))
            .select("row", F.array(*(f"_{j}" for j in range(width)), F.lit(0).cast("long")).alias("more")))
    return out.select("key", "total", "row").join(more, "row", "left").select("key", F.expr(
        "if(more is null, total, zip_with(total, more, (x, y) -> x + y))").alias("total"))


def _training(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))


def learned(told: DataFrame, counts: DataFrame) -> tuple[Model, Spelled]:
    """Models of all languages of ``counts`` (lang, gram, n; lang is null where nothing is learned), with the costs of all its grams.

    Confidence is calibrated on every text of ``told`` (doc_id, lang, text), however long, whose grams are all among ``counts``.
    Languages are entries of the arrays of every gram, so they are meant to be thousands at most.
    """
    langs = sorted(r["lang"] for r in counts.where("lang is not null").select("lang").distinct().collect())
    model = Model(langs)
    if langs:
        levels = levels_of(counts)
        off = discounts(levels)
        ones, top = _shares(levels[1], 1, langs, off)
        twos, weights = _shares(levels[2], 2, langs, off)
        model.ones, model.twos, model.weights = (written(t, name) for t, name in ((ones, "ones"), (twos, "twos"), (weights, "weights")))
        model.arrays = written(packed(levels, langs, off), "gram_arrays")
        first = top.first()
        model.left = [1.0 if v is None else v for v in (first["backoff"] if first else [None] * len(langs))]
        for k in range(1, ORDER):
            dropped(levels[k])
    spelled = model.spelled(counts)
    told = told.where("lang is not null and text is not null").select("lang", "text")
    return (calibrated(model, totals(told, spelled)) if langs else model), spelled


def calibrated(model: Model, told: DataFrame) -> Model:
    """``model`` with the limit and the sharpness that every row of ``told`` (key, total), whose language is ``key``, speaks for.

    A task hands on whole numbers of steps, whose sums do not depend on their order. Only these sums and the share of
    costs above the quantile reach the driver.
    """
    langs = model.langs
    places = {lang: i for i, lang in enumerate(langs)}

    def piece(columns):
        known = [(places[lang.decode()], total) for lang, total in zip(*columns, strict=True) if lang.decode() in places and total[-1]]
        if not known:
            return [], []
        right, (bits, _) = np.array([k for k, _ in known]), bits_of(np.array([t for _, t in known]))
        own = bits[np.arange(len(bits)), right]
        margins = bits - own[:, None]
        unlike = np.column_stack([np.log(np.exp2(np.clip(-s * margins, -1000, 1000)).sum(1)) for s in SHARPNESSES])
        return np.rint(own * STEPS).astype(np.int64), np.rint(unlike * STEPS).astype(np.int64).tolist()

    rows = written(mapped(told.select("key", "total"), piece, "own long, unlike array<long>"), "calibration")
    exact = F.col("own").cast("decimal(19,0)")
    n, total, squares, *unlike = rows.agg(F.count("*"), F.sum("own"), F.sum(exact * exact), *(
        F.sum(F.col("unlike")[i].cast("decimal(19,0)")) for i in range(len(SHARPNESSES)))).first()
    if n:
        # The quantile lies between two of the highest costs.
        place = (n - 1) * REJECTED_SHARE
        highest = [r["own"] for r in rows.orderBy(F.desc("own")).limit(int(place) + 2).select("own").collect()]
        above, below = highest[int(place)], highest[min(int(place) + 1, len(highest) - 1)]
        spread = math.sqrt(max(0, n * int(squares) - int(total) ** 2)) / n
        limit = (above - (place - int(place)) * (above - below) + spread) / STEPS
        # The sharpness under which the languages are likeliest.
        model = replace(model, limit=limit, sharpness=SHARPNESSES[unlike.index(min(unlike))])
    dropped(rows)
    return model


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Models of all languages from every text with a language, confidence from the same texts."""
    told = _training(docs, id_column, text_column, lang_column).where("lang is not null and text is not null")
    return learned(told, written(gram_counts(told.select("lang", "text")), "gram_counts"))[0]


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", spelled: Spelled | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, bits_per_char) of every whole text.

    A text that is null or has no letter is ``und`` with score 0. Of languages that cost the same, the first by name is
    taken. A text unlike every language (``rejected``) keeps the nearest one at half its score. Rows are read each
    for itself; null ids stay null; other columns are never read. Texts and words may be of any length, time
    and memory grow in proportion. ``spelled``, if given, has all grams of the texts.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    if spelled is None:
        spelled = model.spelled(gram_counts(rows.select(F.lit(None).cast("string").alias("lang"), "text")))
    predict, summed = replace(model, ones=None, twos=None, weights=None, arrays=None).predict, _summed(spelled)
    schema = "doc_id long, lang_pred string, score double, rejected boolean, bits_per_char double"
    if spelled.others:
        return mapped(totals(rows, spelled), lambda columns: (columns[0], *predict(np.array(columns[1]))), schema)
    return mapped(rows, lambda columns: (columns[0], *predict(summed(columns[1])[0])), schema)


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ...) of every document, by models of those outside the fold.

    One in LEFT_OUT of the documents that may be learned from is left out of the counts; confidence is calibrated on all of these.
    """
    fold = fold_of("doc_id", FOLDS)
    rows = _training(docs, "doc_id", "text", "lang").withColumn("lang", F.when(fold != HELD_OUT, F.col("lang")))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(LEFT_OUT)) == 0
    # One reading gives what is learned and all grams that are looked up.
    counts = written(gram_counts(rows.where("text is not null").select(F.when(~apart, F.col("lang")).alias("lang"), "text")), "gram_counts")
    model, spelled = learned(rows.where(apart), counts)
    for table in (model.ones, model.twos, model.weights, model.arrays, counts):
        if table is not None:
            dropped(table)
    return scored(docs, model, spelled=spelled).select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")
