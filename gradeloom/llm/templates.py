"""Benchmark decontamination by template canonicalisation.

Texts become tokens: numbers, names (capitalised inside a sentence) and units (after a number) turn into typed
placeholders, all else into lower-cased words.  Every window of eight tokens has one key: its placeholders and words if
five tokens or more are words, else its tokens with their values.  Windows of documents and of benchmark items meet in
a hash join on the key, and each slot of a match says that a value of the item stands for a value of the document.

Matches of one document and item with equal distance of their places are an alignment.  One in which a name stands for
two names tells another question and is dropped.  Over the others one map of values holds: a value stands for what the
alignment with the most windows says, there the most frequent (ties: the alignment further to the left, the value seen
first).  Matches that contradict the map don't count.  A document leaks an item if what is left holds half of the item's
different windows, or six of them.  So a question with other numbers, names or units is found, while texts of like
grammar are not.

Cases: null, empty and short texts leak nothing; an item of four to seven tokens is one window, with placeholders if
four tokens are words; items of fewer tokens and null item texts are ignored; repeated rows and ties are judged each,
also when they share a doc_id; empty tables on either side leak nothing; further columns are ignored, or pass through
``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rowbatch, shared, wordhash

WINDOW, LEAST_WORDS, LEAST_SHORT, ENOUGH_WINDOWS = 8, 5, 4, 6
#: The filter that goes to all tasks has 2**SKETCH_BITS bits, whatever the size of the benchmark: 2 MB.
SKETCH_BITS = 24
ITEMS = "item long, item_id long, item_windows long, size int, there int, hash long, kinds array<tinyint>, x array<long>"
CANDIDATES = "row long, doc_id long, mark long, hash long, here int, y array<long>"
#: Units that follow numbers.
UNITS = """
mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles nm
mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds
ml cl dl l liter liters litre litres gal gallon gallons pint pints cup cups
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
usd eur gbp vnd dollar dollars euro euros cent cents đồng
kmh mph kwh w kw v hz khz mhz ghz kb mb gb tb degrees degree percent
""".split()
_NUM, _NAME, _UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
_VALUES = np.uint64(0x9E3779B97F4A7C15)
_WORD, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(u) for u in raw])
    return np.sort(wordhash.ranges(np.frombuffer(b"".join(raw), np.uint8), ends - [len(u) for u in raw], ends, fold=True))


class Tokens:
    """Tokens of texts one after another: starts, ends, text numbers, codes (placeholders 1 to 3, words hashed), values hashed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        digit = _DIGIT[data]
        kind = np.where(digit, 2, np.where(_WORD[data], 1, 0)).astype(np.int8)
        if len(data) > 2:  # a point or comma between digits belongs to the number
            kind[1:-1][((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]] = 2
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        inside = kind[edges[:-1]] > 0 if len(data) else np.zeros(0, bool)
        self.starts, self.ends = edges[:-1][inside], edges[1:][inside]
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        number = kind[self.starts] == 2
        lead, second = data[self.starts], data[np.minimum(self.starts + 1, max(len(data) - 1, 0))] if len(data) else data
        capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        stops = np.concatenate([[0], np.cumsum((data == 10) | (data == 33) | (data == 46) | (data == 63))])
        opens = np.ones(len(self.starts), bool)
        opens[1:] = (self.text[1:] != self.text[:-1]) | (stops[self.starts[1:]] > stops[self.ends[:-1]])
        self.codes = wordhash.ranges(data, self.starts, self.ends, fold=True) | np.uint64(4)
        self.values = self.codes.copy()
        units = np.zeros(len(number), bool)
        units[1:] = number[:-1] & (self.text[1:] == self.text[:-1]) & ~number[1:]
        at = np.flatnonzero(units)
        units[at] = np.isin(self.codes[at], _unit_hashes() | np.uint64(4))
        self.codes[capital & ~opens & ~number] = _NAME
        self.codes[units] = _UNIT
        self.codes[number] = _NUM
        self.words = np.concatenate([[0], np.cumsum(self.codes > _UNIT)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key and first token of each window, and whether it has placeholders (else values)."""
        h, at = wordhash.grams(self.codes, self.text, size)
        plain = self.words[at + size] - self.words[at] >= (LEAST_WORDS if size == WINDOW else LEAST_SHORT)
        exact, _ = wordhash.grams(self.values, self.text, size)
        return wordhash.scramble(np.where(plain, h, exact ^ _VALUES) + np.uint64(size)), at, plain

    def slots(self, at: np.ndarray, plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List offsets, kinds and values of the slots of windows; windows of values have none."""
        place = at[:, None] + np.arange(size)
        slot = (self.codes[place] <= _UNIT) & plain[:, None]
        place = place[slot]
        return np.append(0, np.cumsum(slot.sum(axis=1))).astype(np.int32), self.codes[place].astype(np.int8), self.values[place].view(np.int64)


def item_windows(bench: DataFrame) -> DataFrame:
    """A row a window of the benchmark, with the number of its item's different windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text"):
            tokens = Tokens(*rowbatch.text_bytes(batch.column("text")))
            held = np.bincount(tokens.text, minlength=batch.num_rows)
            first = np.cumsum(held) - held
            for size in range(LEAST_SHORT, WINDOW + 1):
                h, at, plain = tokens.windows(size)
                mine = np.minimum(held[tokens.text[at]], WINDOW) == size
                h, at, plain = h[mine], at[mine], plain[mine]
                owner = tokens.text[at]
                distinct = np.unique(np.rec.fromarrays([owner, h])).f0
                offsets, kinds, values = tokens.slots(at, plain, size)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(take), batch.column("item_id").take(take), pa.array(np.bincount(distinct, minlength=batch.num_rows)[owner]), pa.array(np.full(len(at), size, np.int32)),
                     pa.array((at - first[owner]).astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kinds)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=[f.split()[0] for f in ITEMS.split(", ")])

    known = bench.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return known.mapInArrow(run, ITEMS)


def sketch_of(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of each key: at most 2**bits / 64 words, however large the benchmark."""
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = items.groupBy(F.shiftright(low, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(hash & 63 as int)))").alias("set"))
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    got = words.toArrow()
    out[got.column("at").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return out


def candidates(docs: DataFrame, sizes: list[int], sketch: np.ndarray) -> DataFrame:
    """Windows of ``docs`` (row, doc_id, mark, text) that the filter lets pass, with the values of their slots."""
    spread = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for batch in rowbatch.small(batches, "text"):
            tokens = Tokens(*rowbatch.text_bytes(batch.column("text")))
            first = np.searchsorted(tokens.text, np.arange(batch.num_rows))
            for size in sizes:
                h, at, plain = tokens.windows(size)
                near = (bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0
                h, at, plain = h[near], at[near], plain[near]
                offsets, _, values = tokens.slots(at, plain, size)
                owner = tokens.text[at]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("row", "doc_id", "mark")), pa.array(h.view(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=[f.split()[0] for f in CANDIDATES.split(", ")])

    return docs.mapInArrow(run, CANDIDATES)


def judged(matches: DataFrame) -> DataFrame:
    """Leaks from matches: one deal by (document, item), which all windows and sums below share.

    The rows of one document and item are bounded by their lengths.
    """
    pair = ["row", "item"]
    slots = matches.repartition(*pair).select("*", (F.col("here") - F.col("there")).alias("shift"), F.posexplode_outer(F.arrays_zip("kinds", "x", "y")).alias("j", "s"))
    slots = slots.select(*pair, "doc_id", "mark", "item_id", "item_windows", "hash", "here", "shift", F.coalesce("j", F.lit(0)).alias("j"), F.col("s.kinds").alias("kind"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    value, aligned = W.partitionBy(*pair, "shift", "kind", "x"), W.partitionBy(*pair, "shift")
    torn = F.coalesce((F.col("kind") == int(_NAME)) & (F.min("y").over(value) != F.max("y").over(value)), F.lit(False))
    whole = slots.withColumn("torn", torn).withColumn("torn", F.max("torn").over(aligned)).withColumn("size", F.count_if(F.col("j") == 0).over(aligned)).where("not torn")
    said = W.partitionBy(*pair, "kind", "x", "rank", "y")
    ranked = whole.withColumn("rank", F.dense_rank().over(W.partitionBy(*pair).orderBy(F.desc("size"), "shift")))
    voted = ranked.withColumn("support", F.count("*").over(said)).withColumn("seen", F.min(F.col("here").cast("long") * WINDOW + F.col("j")).over(said))
    best = F.first("y").over(W.partitionBy(*pair, "kind", "x").orderBy("rank", F.desc("support"), "seen"))
    about = [*pair, "doc_id", "mark", "item_id", "item_windows"]
    agreed = voted.withColumn("agrees", F.coalesce(F.col("y") == best, F.lit(True))).groupBy(*about, "hash", "here", "shift").agg(F.min("agrees").alias("agrees"), F.min(F.coalesce(F.col("x") == F.col("y"), F.lit(True))).alias("same"))
    different = agreed.where("agrees").groupBy(*about, "hash").agg(F.min("here").alias("here"), F.min("same").alias("same"))
    counted = different.groupBy(*about).agg(F.count("*").alias("n_windows"), F.min("here").cast("long").alias("first_token"), F.min("same").alias("same"))
    enough = (F.col("n_windows") >= ENOUGH_WINDOWS) | (2 * F.col("n_windows") >= F.col("item_windows"))
    return counted.where(enough).select("doc_id", "mark", "item_id", "n_windows", "item_windows", "first_token", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"))


def leak_rows(docs: DataFrame, bench: DataFrame, bits: int) -> DataFrame:
    """Leaks of ``docs`` with ``mark``, a hash of the text: one scan of the documents, and shuffles of matches only.

    The keys of the benchmark are a saved table, so that the join broadcasts it by its real size or else shuffles both
    sides.  Its filter is of one size and lets all pass when it is full; it decides nothing.
    """
    items = shared.saved(item_windows(bench), "templates")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    rows = docs.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    near = candidates(rows, sizes, sketch_of(items, bits))
    return judged(shared.saved(near.join(items, "hash"), "template-matches"))


def find_leaks(docs: DataFrame, bench: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    return leak_rows(docs, bench, bits).drop("mark")


def drop_leaks(docs: DataFrame, bench: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` without the rows that leak an item: those of equal doc_id and text share their fate."""
    gone = shared.saved(leak_rows(docs, bench, bits).select(F.col("doc_id").alias("__leak_id"), F.col("mark").alias("__leak_mark")).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_mark")), "left_anti")
