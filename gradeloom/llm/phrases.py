"""Phrase collocation mining by contiguous pattern growth in the manner of PrefixSpan.

1. Words are counted per language, each batch for itself before the shuffle.  A word of a language goes by a 64-bit key from then on;
   the saved vocabulary shows whether two words share one, and if any do, all is counted again with another seed.
2. Every occurrence of a frequent word before another is a pointer of that word's projected database.  As a pointer
   into another machine's text is of no use, it carries the keys of the words to its right; equal ones of a batch are one row with a
   weight.  A bounded filter of frequent words saves rows and decides nothing.
3. The pointers of a prefix go to one task, sorted, and grow to the right depth first: a run of equal next words is the projected database of the longer
   prefix, and prefixes below the least frequency grow no further.  A prefix with more than a small part of all pointers is
   dealt out by its next word, and a pair with more than that by all words of the pointer; the counts of such pairs are summed afterwards.
4. Cuts, scores and containment are joins of frequent patterns with the vocabulary and with one another.

Texts have A-Z lower-cased, pieces end at . , ; : ! ? and line breaks (LF, VT, FF, CR), and words are runs of other bytes than space and tab.

Cases: a null text has no words; a null language counts as ``und``, together with rows that say so; repeated rows count
each; of equal scores the higher frequency and then the lesser phrase in byte order comes first, so no ranks are shared; an empty
table, or one without frequent phrases, gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, rowbatch, shared, wordhash

LEAST, MAX_WORDS, TOP, COVERED_PERCENT = 10, 3, 2000, 50
#: Text bytes whose words are counted together, and pointers that are combined and grown together.
BATCH_BYTES, POINTERS = 4 << 20, 1 << 20
#: Prefixes and pairs with a part of all words above 1/HOT, and with so many at least, are dealt out.
HOT, LEAST_HOT = 1 << 13, 1 << 12
#: The filter of frequent words has a bit for 1/16 of a word, and at most so many (as a power of two).
FILTER_BITS = 27
#: The best of a language are found among the best of so many groups of its phrases.
GROUPS = 64
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\v\f\r")] = True
_WORD = ~_BREAKS
_WORD[list(b" \t")] = False


def keyed_words(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts, ends, texts and keys of all words, and whether the next word goes on in the piece."""
    data, offsets = rowbatch.text_bytes(batch.column("text"))
    starts, ends, text = wordhash.words(data, offsets, _WORD)
    langs, at = rowbatch.text_bytes(batch.column("lang"))
    lang = wordhash.ranges(langs, at[:-1], at[1:], seed=seed)
    keys = wordhash.mix(lang[text], wordhash.ranges(data, starts, ends, fold=True, seed=seed))
    keys[keys == 0] = 1  # 0 stands for no word
    breaks = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(_BREAKS[data], out=breaks[1:])
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return data, starts, ends, text, keys, goes_on


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """key, lang, word and n of every word; and key, next and n of pairs that are frequent in some batch, for hot pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text", BATCH_BYTES):
            data, starts, ends, text, keys, goes_on = keyed_words(batch, seed)
            found, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            lowered, size, lang = wordhash.lower(data), ends - starts, batch.column("lang").dictionary_encode().indices.to_numpy()[text]
            alike = bpe.equal(lowered, starts, size, lowered, starts[first[which]], size[first[which]]) & (lang == lang[first[which]])
            odd = np.flatnonzero(~alike)  # words with the key of another: rows of their own, which show that
            counts -= np.bincount(which[odd], minlength=len(found))
            found, first, counts = np.append(found, keys[odd]), np.append(first, odd), np.append(counts, np.ones(len(odd), np.int64))
            size = size[first]
            ends_at = np.cumsum(size)
            spread = np.repeat(starts[first] - (ends_at - size), size) + np.arange(int(size.sum()))
            offsets = np.append(0, ends_at)
            words = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lowered[spread])]).cast(pa.large_string()).cast(pa.string())
            lang = batch.column("lang").take(pa.array(text[first]))
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), none, lang, words, pa.array(counts)], names=["key", "next", "lang", "word", "n"])
            left = np.flatnonzero(goes_on)
            pairs, at, counts = np.unique(wordhash.mix(keys[left], keys[left + 1]), return_index=True, return_counts=True)
            many = counts > max(64, len(left) // HOT)
            left, counts = left[at[many]], counts[many]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[left].view(np.int64)), pa.array(keys[left + 1].view(np.int64)), pa.nulls(len(left), pa.string()), pa.nulls(len(left), pa.string()), pa.array(counts)],
                names=["key", "next", "lang", "word", "n"])

    return docs.mapInArrow(run, "key long, next long, lang string, word string, n long").groupBy("key", "next", "lang", "word").agg(F.sum("n").alias("n"))


def word_filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bits set at two places of every key; at most 2**bits of them, however many words there are."""
    low = [F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("key", 64 - bits)]
    places = frequent.select(F.explode(F.array(*low)).alias("p"))
    got = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << bits >> 6, np.uint64)
    out[got.column("at").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return out


def passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(words).bit_length() + 5)
    out = np.ones(len(keys), bool)
    for place in (keys & np.uint64((len(words) << 6) - 1), keys >> (np.uint64(64) - bits)):
        out &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def combined(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and their summed weights; one column is put in order at a time, so that no sorted copy of all is held."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    edges = np.flatnonzero(new)
    summed = np.add.reduceat(weight[order], edges) if len(edges) else weight
    first = order[edges]
    return [c[first] for c in columns], summed


def dealt_keys(columns: list[np.ndarray], hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which of a hot prefix's tasks a pointer goes to; 0 for others.  ``hot``: words and their deals, pairs and theirs."""
    words, word_deals, pairs, pair_deals = hot
    out = np.zeros(len(columns[0]), np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, columns[0]), len(words) - 1)
        is_hot = words[at] == columns[0]
        out[is_hot] = (wordhash.scramble(columns[1][is_hot]) % word_deals[at[is_hot]].astype(np.uint64)).astype(np.int64)
    if len(pairs):
        pair = wordhash.mix(columns[0], columns[1])
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        is_hot = pairs[at] == pair
        whole = columns[1][is_hot]
        for c in columns[2:]:
            whole = wordhash.mix(whole, c[is_hot])
        out[is_hot] = (wordhash.scramble(whole) % pair_deals[at[is_hot]].astype(np.uint64)).astype(np.int64)
    return out


def pointers(docs: DataFrame, seed: int, words: np.ndarray, hot: tuple[np.ndarray, ...], most: int) -> DataFrame:
    """A row for each different run of ``most`` words that starts with two frequent ones: w1 to w<most>, deal, n.

    A word after the piece's end, or after one that isn't frequent, is 0.
    """
    names = [f"w{i + 1}" for i in range(most)]
    spread = docs.sparkSession.sparkContext.broadcast((words, hot))

    def out(held: list[list[np.ndarray]], hot: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        columns, n = combined(columns, np.ones(len(columns[0]), np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(dealt_keys(columns, hot)), pa.array(n)], names=[*names, "deal", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = spread.value
        held: list[list[np.ndarray]] = []
        for batch in rowbatch.small(batches, "text", BATCH_BYTES):
            *_, keys, goes_on = keyed_words(batch, seed)
            known = passes(keys, words)
            goes_on[:-1] &= known[1:]
            at = np.flatnonzero(known & goes_on)
            columns, going = [keys[at]], np.ones(len(at), bool)
            for i in range(1, most):
                going &= goes_on[np.minimum(at + i - 1, len(keys) - 1)]
                columns.append(np.where(going, keys[np.minimum(at + i, len(keys) - 1)], np.uint64(0)))
            held.append(columns)
            if sum(len(c[0]) for c in held) >= POINTERS:
                yield out(held, hot)
                held = []
        if held:
            yield out(held, hot)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "deal", "n"]))


class Grower:
    """Grows the prefixes of sorted pointers; collects frequent patterns as words and frequency.

    ``parts``: keys of pairs whose pointers other tasks, or other parts of this one, hold too.  All that grows from
    these but patterns of full length counts here in part only, and leaves whatever its frequency.
    """

    def __init__(self, most: int, least: int, parts: np.ndarray) -> None:
        self.most, self.least, self.parts = most, least, parts
        self.found: list[list[int]] = []

    def grow(self, columns: list[np.ndarray], weight: np.ndarray, lo: int, hi: int, prefix: list[int], in_part: bool = False) -> None:
        """Extends ``prefix``, whose pointers are the rows from ``lo`` to ``hi``, by every frequent next word in turn."""
        depth = len(prefix)
        words = columns[depth][lo:hi]
        edges = np.append(0, np.flatnonzero(words[1:] != words[:-1]) + 1)
        sums, stops = np.add.reduceat(weight[lo:hi], edges), np.append(edges[1:], hi - lo)
        next_words, whole = words[edges], depth + 1 == self.most
        some = sums >= (1 if in_part and not whole else self.least)
        parts = np.full(len(edges), in_part)
        if depth == 1 and not whole and len(self.parts):
            parts = np.isin(wordhash.mix(np.array(prefix).view(np.uint64), next_words.view(np.uint64)), self.parts)
            some |= parts
        for i in np.flatnonzero(some & (next_words != 0)).tolist():
            longer = [*prefix, int(next_words[i])]
            if depth:
                self.found.append([*longer, *[0] * (self.most - depth - 1), int(sums[i])])
            if not whole:
                self.grow(columns, weight, lo + int(edges[i]), lo + int(stops[i]), longer, bool(parts[i]))

    def tear(self, columns: list[np.ndarray]) -> None:
        """The pair of the last row goes on beyond the rows grown so far."""
        self.parts = np.union1d(self.parts, wordhash.mix(columns[0][-1:].view(np.uint64), columns[1][-1:].view(np.uint64)))

    def taken(self) -> list[np.ndarray]:
        rows, self.found = np.array(self.found, np.int64).reshape(-1, self.most + 1), []
        return [np.ascontiguousarray(rows[:, i]) for i in range(self.most + 1)]


def complete(columns: list[np.ndarray], limit: int) -> tuple[int, bool]:
    """How many leading rows of sorted pointers can be grown while more are to come, and whether that tears a pair.

    All before the last prefix; if that prefix has over ``limit`` rows, all before its last pair; if that has, all
    before its last run of words.
    """
    n = len(columns[0])
    same = np.ones(n, bool)
    for depth, c in enumerate(columns):
        same &= c == c[-1]
        start = n - int(same.sum())
        if n - start <= limit or depth == len(columns) - 1:
            return start, depth > 1
    return 0, False


def patterns(rows: DataFrame, most: int, least: int, hot_pairs: np.ndarray) -> DataFrame:
    """w1 to w<most> (0: no word) and frequency ``a`` of every run of two to ``most`` words with at least ``least``."""
    names = [f"w{i + 1}" for i in range(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grower, rest, weight = Grower(most, least, hot_pairs), [np.empty(0, np.int64)] * most, np.empty(0, np.int64)

        def grown(n: int) -> pa.RecordBatch:
            if n:
                grower.grow(rest, weight, 0, n, [])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in grower.taken()], names=[*names, "a"])

        for batch in batches:
            rest = [np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(rest, names)]
            weight = np.concatenate([weight, batch.column("n").to_numpy()])
            if len(weight) < POINTERS // 8:
                continue
            n, torn = complete(rest, POINTERS // 2)
            if torn:
                grower.tear(rest)
            yield grown(n)
            rest, weight = [c[n:] for c in rest], weight[n:]
            rest, weight = combined(rest, weight)
        if len(weight):
            yield grown(len(weight))

    sent = rows.repartition("w1", "deal").sortWithinPartitions(*names)
    grown = sent.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"]))
    return grown.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def hot_prefixes(known: DataFrame, total: int) -> tuple[np.ndarray, ...]:
    """Words and pairs (as one key) with more than 1/HOT of all words: at most HOT of each; and the tasks that each is dealt to."""
    limit = max(LEAST_HOT, total // HOT)
    many = known.where(F.col("n") > limit).orderBy(F.desc("n"), "key", "next")
    out = []
    for some in (many.where("next is null"), many.where("next is not null")):
        got = some.select("key", "next", "n").limit(HOT).toArrow()
        keys = got.column("key").to_numpy().view(np.uint64)
        if got.column("next").null_count == 0 and len(keys):
            keys = wordhash.mix(keys, got.column("next").to_numpy().view(np.uint64))
        order = np.argsort(keys)
        out += [keys[order], got.column("n").to_numpy()[order] // limit + 1]
    return tuple(out)


def counted(docs: DataFrame) -> tuple[DataFrame, int, str]:
    """The vocabulary in a saved table, the seed that gives all its words different keys, and the table's path."""
    seed = 0
    while True:
        known, path = shared.saved_at(vocabulary(docs, seed), "phrase-words")
        if known.where("next is null").groupBy("key").count().where("count > 1").isEmpty():
            return known, seed, path
        shared.remove(docs.sparkSession, path)
        seed += 1


def best_cut(cuts: list[tuple[Column, Column]]) -> Column:
    """The cut (score, k, l, r) of the lowest score; the first of equal ones."""
    wide = "decimal(20,0)"
    square = F.col("a").cast(wide) * F.col("a").cast(wide) * F.lit(1_000_000).cast("decimal(7,0)")
    scored = [F.struct(F.call_function("div", square, left.cast(wide) * right.cast(wide)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts, 1)]
    return F.array_min(F.array(*scored))


def mine(docs: DataFrame, least: int = LEAST, most: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """Each language's best phrases of two to ``most`` words: lang, rank, phrase, a, l, r, n, score.

    ``least``: the lowest frequency.  A phrase goes if a longer one that holds it has ``covered_percent`` of its frequency.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    known, seed, known_path = counted(source)
    words = known.where("next is null")
    totals, totals_path = shared.saved_at(words.groupBy("lang").agg(F.sum("n").alias("n_lang")), "phrase-totals")
    total = totals.agg(F.coalesce(F.sum("n_lang"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") >= least)
    bits = min(FILTER_BITS, max(10, (16 * frequent.count()).bit_length()))
    hot = hot_prefixes(known, total)
    rows = pointers(source, seed, word_filter(frequent, bits), hot, most)
    found, found_path = shared.saved_at(patterns(rows, most, least, hot[2]), "phrase-patterns")

    names = [f"w{i + 1}" for i in range(most)]
    empty = lambda size: F.lit(True) if size == most else F.col(names[size]) == 0
    of_size = {size: found.where((F.col(names[size - 1]) != 0) & empty(size)) for size in range(2, most + 1)}

    def joined(left: DataFrame, size: int, at: int, value: str) -> DataFrame:
        """``left`` with the frequency of the ``size`` words from the one numbered ``at``."""
        own = of_size[size].select(*(F.col(names[i]).alias(f"k{i}") for i in range(size)), F.col("a").alias(value))
        return left.join(shared.dealt(own), [F.col(names[at + i]) == F.col(f"k{i}") for i in range(size)]).drop(*(f"k{i}" for i in range(size)))

    done = None
    for size in range(2, most + 1):
        some = of_size[size].select(*names[:size], "a")
        for i in range(size):
            columns = [F.col("key").alias("k"), F.col("word").alias(f"word{i}"), F.col("n").alias(f"f{i}"), *([F.col("lang")] if i == 0 else [])]
            some = some.join(shared.dealt(frequent.select(*columns)), F.col(names[i]) == F.col("k")).drop("k")
        for cut in range(2, size):
            some = joined(joined(some, cut, 0, f"l{cut}"), cut, size - cut, f"r{cut}")
        left = {1: F.col("f0")} | {k: F.col(f"l{k}") for k in range(2, size)}
        right = {1: F.col(f"f{size - 1}")} | {k: F.col(f"r{k}") for k in range(2, size)}
        longer = [of_size[big].select(*(F.col(names[at + i]).alias(f"k{i}") for i in range(size)), F.col("a").alias("held")) for big in range(size + 1, most + 1) for at in range(big - size + 1)]
        if longer:
            union = longer[0]
            for x in longer[1:]:
                union = union.unionByName(x)
            held = union.groupBy(*(f"k{i}" for i in range(size))).agg(F.max("held").alias("held"))
            some = some.join(held, [F.col(names[i]) == F.col(f"k{i}") for i in range(size)], "left").where(F.col("held").isNull() | (100 * F.col("held") < covered_percent * F.col("a")))
        cut = best_cut([(left[k], right[size - k]) for k in range(1, size)])
        scored = some.select("lang", F.concat_ws(" ", *(f"word{i}" for i in range(size))).alias("phrase"), "a", cut.alias("cut"))
        done = scored if done is None else done.unionByName(scored)
    flat = done.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).alias("group"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for group in (["lang", "group"], ["lang"]):
        flat = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = flat.join(totals.select(F.col("lang").alias("of"), "n_lang"), F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score")
    out = shared.saved(best, "phrases")
    for path in (known_path, totals_path, found_path):
        shared.remove(docs.sparkSession, path)
    return out
