"""Self join of documents by Jaccard similarity of word shingles, by vertical partitioning.

The n-gram order (by hash) is cut into fragments.  Three rounds work on fragments of it:

1. Frequencies.  Every fragment gets its part of all documents' sets, packed, with copies of one set dropped.  It keeps
   n-grams of two sets or more; the others link nothing.  A document that keeps less than 3/4 of its set is out.
   N-grams that very many sets hold, as a sample of sets tells, are not gathered in their fragments: they count as
   shared, come last in the order of frequency, and are dealt by set.  The sample decides on nothing but that.
2. Candidates.  Linked sets share an n-gram of their prefixes (the rarest quarter of a set).  Sets that hold one
   n-gram there are joined to the least of them, which gives clusters beyond which no pair can be linked.
3. Overlaps.  Clusters are dealt in blocks of bounded size, and blocks meet in pairs if set sizes allow links.  For each
   pair of blocks and fragment of the order a task counts the partial overlaps of the sets there, and leaves out pairs
   that all other fragments together couldn't save.  Packed counts meet again by pair of blocks, are summed per pair
   of sets, and compared with the threshold exactly, in integers.  What is returned is a spanning star of each local
   component: no pair of sets ever is a row.

Copies of one set are one node throughout, so groups of copies are never expanded into pairs.

Cases: words are lower-cased in A-Z; a text of fewer words than a shingle has one shingle, all of them; a null, empty
or wordless text has none and is alone; null doc_ids never name a component of others; repeated rows are copies; an
empty table gives an empty table; further columns are ignored, or pass through ``keep_one``.  N-grams are told apart by
45 bits or more of a 64-bit hash, sets by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rowbatch, shared, wordhash
from .components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: N-grams a task of round 1 holds at once, text bytes packed together; sets and n-grams of a block, fragments of round 3
#: and co-occurrences counted at a time.
FRAGMENT_GRAMS, PACK_BYTES = 1 << 20, 4 << 20
BLOCK_SETS, BLOCK_GRAMS, FRAGMENTS, EXPANDED = 512, 400_000, 4, 1_000_000
LOW_BITS, SET_BITS, LEAST_FRAGMENTS = 40, 24, 8
#: Sets looked at for very frequent n-grams, the part of them that makes one (times their number at least so many), the
#: most such n-grams; and the part of all documents that makes a set of very many copies.
SAMPLE, FREQUENT, LEAST_FREQUENT, MOST_FREQUENT, COPIED = 8192, 1 / 64, 32, 1 << 16, 1 / 1024
#: Deals of the rows of one large component.
SALTS = 64


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts one after another, their text numbers, and each text's count."""
    starts, ends, text = wordhash.words(data, offsets)
    word = wordhash.ranges(data, starts, ends, fold=True)
    grams, at = wordhash.grams(word, text, size)
    owner = text[at]
    n = len(offsets) - 1
    held = np.bincount(text, minlength=n)
    for k in range(1, size):  # texts of k words: all of them together
        if len(some := np.flatnonzero(held == k)):
            first = np.searchsorted(text, some)
            h = word[first].copy()
            for i in range(1, k):
                h = h * np.uint64(wordhash._BASE) + word[first + i]
            grams = np.concatenate([grams, wordhash.scramble(h + np.uint64(k))])
            owner = np.concatenate([owner, some])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, owner, np.bincount(owner, minlength=n)


def set_ids(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: the sum of its scrambled n-grams and its size."""
    sums = np.append(np.uint64(0), np.cumsum(wordhash.scramble(grams)))
    ends = np.append(0, np.cumsum(counts))
    return wordhash.scramble(sums[ends[1:]] - sums[ends[:-1]] + counts.astype(np.uint64)).view(np.int64)


def catalogue(docs: DataFrame, size: int, part: float) -> DataFrame:
    """doc_id, hash of the text, number of shingles and set id of every document; the n-grams of a ``part`` of all sets."""
    limit = np.uint64(min(int(part * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text"):
            grams, _, counts = sets_of(*rowbatch.text_bytes(batch.column("text")), size)
            ids = set_ids(grams, counts)
            ends = np.cumsum(counts)
            chosen = ids.view(np.uint64) <= limit
            sample = [grams[e - n : e].tobytes() if ok else None for ok, e, n in zip(chosen.tolist(), ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(counts.astype(np.int64)), pa.array(ids), pa.array(sample, pa.binary())], names=["doc_id", "mark", "n_shingles", "set_id", "sample"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, set_id long, sample binary")


def very_frequent(known: DataFrame, frequent: float) -> np.ndarray:
    """The n-grams that a ``frequent`` part of the sampled sets hold, sorted: MOST_FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = np.unique(np.frombuffer(b"".join(batch.column("sample").to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    sets = known.where("sample is not null and n_shingles > 0").groupBy("set_id").agg(F.first("sample").alias("sample"))
    least = max(LEAST_FREQUENT, int(sets.count() * frequent))
    counted = sets.select("sample").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.gram for r in counted.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def much_copied(known: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a COPIED part of all documents, sorted, and the doc_id that stands for each (-1: none has one)."""
    many = known.where("n_shingles > 0").groupBy("set_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > max(LEAST_FREQUENT, int(rows * COPIED)))
    got = sorted((r.set_id, -1 if r["first"] is None else r["first"]) for r in many.collect())
    return np.array([i for i, _ in got], np.int64), np.array([d for _, d in got], np.int64)


def _pack(grams: np.ndarray) -> bytes:
    """The low 40 bits of each."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def cut_order(grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragments of n-gram hashes, and their places in these, in 40 bits."""
    width = np.uint64((1 << 64) // count + 1)
    part = grams // width
    return part.astype(np.int64), (grams - part * width) >> np.uint64(64 - LOW_BITS - (count.bit_length() - 1))


def fragments(docs: DataFrame, size: int, count: int, hot: np.ndarray, copied: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Packed parts of all sets: a row a fragment and some megabytes of text.

    A part is the set's id, its size, one byte for the number of n-grams here, and five an n-gram.  ``hot`` n-grams
    (sorted) go by set to fragments beyond ``count``; much ``copied`` sets come from one document.
    """
    spread = docs.sparkSession.sparkContext.broadcast((hot, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, (many, stands) = spread.value
        for batch in gathered(batches):
            grams, owner, counts = sets_of(*rowbatch.text_bytes(batch.column("text")), size)
            ids = set_ids(grams, counts)
            _, first = np.unique(ids, return_index=True)
            one = np.zeros(len(ids), bool)
            one[first] = True  # copies in one batch go here already
            if len(many):
                at = np.minimum(np.searchsorted(many, ids), len(many) - 1)
                stand = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False) == stands[at]
                one = np.where((many[at] == ids) & (stands[at] >= 0), stand, one)
            one = one[owner]
            grams, owner = grams[one], owner[one]
            sizes = counts.astype(np.uint32)
            part, place = cut_order(grams, count)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                often = hot[at] == grams
                place[often] = at[often].astype(np.uint64)
                part[often] = count + (ids[owner[often]].view(np.uint64) % np.uint64(count)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            place, owner, part = place[order], owner[order], part[order]
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            rows = {k: [] for k in ("fragment", "ids", "sizes", "counts", "grams")}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                heads, runs = _runs(owner[a:b])
                rows["fragment"].append(int(part[a]))
                rows["ids"].append(ids[owner[a:b][heads]].tobytes())
                rows["sizes"].append(sizes[owner[a:b][heads]].tobytes())
                rows["counts"].append(runs.astype(np.uint8).tobytes())
                rows["grams"].append(_pack(place[a:b]))
            if rows["fragment"]:
                yield pa.RecordBatch.from_pydict({"fragment": pa.array(rows.pop("fragment"), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in rows.items()}})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "fragment int, ids binary, sizes binary, counts binary, grams binary")


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of one owner; runs of over 255 are cut."""
    place = np.arange(len(owner))
    new = np.diff(owner, prepend=-1) != 0
    head = np.maximum.accumulate(np.where(new, place, 0))
    heads = np.flatnonzero(new | ((place - head) % 255 == 0))
    return heads, np.diff(np.append(heads, len(owner)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about PACK_BYTES of text."""
    held, size = [], 0
    for batch in rowbatch.small(batches, "text", PACK_BYTES):
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sorted_parts(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (n-gram, set), sorted; copies of a set bring the same.  Overwrites ``grams``.

    Up to 2**24 sets share a word with their n-grams, which is sorted in place.
    """
    if len(owner) and int(owner.max()) >> SET_BITS:
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))
        return grams[new], owner[new]
    grams <<= np.uint64(SET_BITS)
    grams |= owner
    grams.sort()
    grams = grams[np.append(True, grams[1:] != grams[:-1])[: len(grams)]]
    return grams >> np.uint64(SET_BITS), (grams & np.uint64((1 << SET_BITS) - 1)).astype(np.uint32)


def shared_grams(packed: DataFrame, targets: int) -> DataFrame:
    """N-grams of two sets or more with their frequency classes, dealt by set: a row a fragment and target."""
    names = ("ids", "sizes", "counts", "grams", "classes")

    def run(table: pa.Table) -> pa.Table:
        fragment = table.column("fragment")[0].as_py()
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        every, sizes, counts = joined("ids", np.int64), joined("sizes", np.uint32), joined("counts", np.uint8)
        ids, first, which = np.unique(every, return_index=True, return_inverse=True)
        sizes = sizes[first]
        grams, owner = sorted_parts(_unpack(b"".join(table.column("grams").to_pylist())), np.repeat(which.astype(np.uint32), counts))
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        runs = np.diff(np.append(heads, len(grams)))
        runs = np.repeat(runs, runs)
        kept = (runs > 1) | (fragment >= targets)
        grams, owner = grams[kept], owner[kept].astype(np.int64)
        classes = np.minimum(254, np.log2(runs[kept]) * 6).astype(np.uint8)
        if fragment >= targets:  # very frequent n-grams, dealt by set
            fragment, classes[:] = targets, 255
        target = (ids.view(np.uint64) % np.uint64(targets)).astype(np.int64)
        order = np.lexsort((owner, target[owner]))
        grams, owner, classes = grams[order], owner[order], classes[order]
        to = target[owner]
        edges = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
        rows: dict[str, list] = {"target": [], **{k: [] for k in names}}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            heads, runs = _runs(owner[a:b])
            some = owner[a:b][heads]
            rows["target"].append(int(to[a]))
            rows["ids"].append(ids[some].tobytes())
            rows["sizes"].append(sizes[some].tobytes())
            rows["counts"].append(runs.astype(np.uint8).tobytes())
            rows["grams"].append(_pack(grams[a:b]))
            rows["classes"].append(classes[a:b].tobytes())
        out = {"target": pa.array(rows.pop("target"), pa.int32()), "fragment": pa.array([fragment] * (len(edges) - 1), pa.int32())}
        return pa.table(out | {k: pa.array(v, pa.binary()) for k, v in rows.items()})

    return packed.repartition(targets, "fragment").groupBy("fragment").applyInArrow(run, "target int, fragment int, " + ", ".join(f"{n} binary" for n in names))


def survivors(dealt: DataFrame, targets: int) -> DataFrame:
    """Sets that share the threshold's part: id, size, shared n-grams of the prefix, and all of them by fragment.

    The prefix is in order of frequency class, then hash; n-grams of no other set come before these and count.  The
    fragments of round 3 are ranges of the order by hash.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("fragment", "ids", "sizes", "counts", "grams", "classes")}
        joined = lambda c, kind: np.frombuffer(b"".join(columns[c]), kind)
        ids, sizes, counts, classes = joined("ids", np.int64), joined("sizes", np.uint32), joined("counts", np.uint8), joined("classes", np.uint8)
        grams = np.concatenate([_unpack(g) | np.uint64(f << LOW_BITS) for f, g in zip(columns["fragment"], columns["grams"])])
        unique, first, which = np.unique(ids, return_index=True, return_inverse=True)
        owner = np.repeat(which, counts)
        held = np.bincount(owner, minlength=len(unique))
        size = sizes[first].astype(np.int64)
        alive = DENOMINATOR * held >= NUMERATOR * size
        some = alive[owner]
        number = np.cumsum(alive) - 1
        grams, owner, classes = grams[some], number[owner[some]], classes[some]
        unique, size, held = unique[alive], size[alive], held[alive]
        order = np.lexsort((grams, classes, owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        prefix = np.maximum(held - -(-NUMERATOR * size // DENOMINATOR) + 1, 0)
        heads = order[place < prefix[owner[order]]]
        part = ((grams >> np.uint64(LOW_BITS)) * np.uint64(FRAGMENTS) // np.uint64(targets + 1)).astype(np.int64)
        cell = owner * FRAGMENTS + part
        lists = lambda n, ends, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(ends, minlength=n))).astype(np.int32)), values)
        order = np.argsort(cell, kind="stable")
        parts = lists(len(unique) * FRAGMENTS, cell, pa.array(grams[order].view(np.int64)))
        whole = lists(len(unique), np.repeat(np.arange(len(unique)), FRAGMENTS), parts)
        return pa.table({"set_id": unique, "size": size, "held": held, "heads": lists(len(unique), owner[heads], pa.array(grams[heads].view(np.int64))), "parts": whole})

    return dealt.repartition(targets, "target").groupBy("target").applyInArrow(run, "set_id long, size long, held long, heads array<long>, parts array<array<long>>")


def partial_overlaps(cluster: np.ndarray, side: np.ndarray, size: np.ndarray, held: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (u * n + v, sorted) that may be linked, and their common n-grams in one fragment.

    Sets meet inside a cluster; of two sides only those of sides 0 and 1.  ``grams``: the n-grams of all sets in this
    fragment one after another, ``counts`` of each; ``held``: shared n-grams in all fragments.  A pair is left out if
    it can't be linked even if the other fragments of the smaller set lie in the other.
    """
    n = len(size)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((side[owner], grams, cluster[owner]))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (cluster[o[1:]] != cluster[o[:-1]])
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(g))) if len(g) else first
    head = np.repeat(first, lengths)
    stop = head + np.repeat(lengths, lengths)
    begin = np.arange(len(g)) + 1
    number = stop - begin
    if side.any():  # each of side 0 meets those of side 1 in its run
        right = np.cumsum(np.append(0, side[o] == 0))
        begin = head + right[stop] - right[head]
        number = np.where(side[o] == 0, stop - begin, 0)
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(number)
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        m = number[at:to]
        a = np.repeat(o[at:to], m)
        b = o[np.repeat(begin[at:to] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        keys, sums = _add(keys, sums, *np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_counts=True))
        at = to
    u, v = keys // max(n, 1), keys % max(n, 1)
    rest = held - counts
    most = sums + np.minimum(rest[u], rest[v])
    alive = DENOMINATOR * most >= NUMERATOR * (size[u] + size[v] - most)
    return keys[alive], sums[alive]


def linked_pairs(size: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of sets, as indexes, from the partial overlaps of all fragments."""
    n = len(size)
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for more, c in found:
        keys, sums = _add(keys, sums, more, c)
    u, v = keys // max(n, 1), keys % max(n, 1)
    linked = DENOMINATOR * sums >= NUMERATOR * (size[u] + size[v] - sums)
    return u[linked], v[linked]


def _add(keys: np.ndarray, sums: np.ndarray, more: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by sorted key."""
    if not len(keys):
        return more, c
    both, total = np.concatenate([keys, more]), np.concatenate([sums, c])
    order = np.argsort(both, kind="stable")
    both, total = both[order], total[order]
    heads = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[heads], np.add.reduceat(total, heads)


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clustered sets, once for each meeting: set id, task (key), side, cluster, size, held and parts.

    A cluster within the bounds meets itself, several of them in one task.  A larger one is cut by size band (a factor
    of 4/3, the largest ratio of linked sizes) and hash; a block meets the blocks of its own band and the next.  What
    is known of large clusters is few rows, which meet their sets in SALTS deals.
    """
    facts = sets.select("set_id", F.col("size").cast("double").alias("size"), "held")
    band = F.floor(F.log("size") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    placed = facts.join(clusters, F.col("set_id") == F.col("node")).select("set_id", "component", "held", band.alias("band"), F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int").alias("salt"))
    held = placed.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("held").alias("g"))
    whole = held.groupBy("component").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    small = (F.col("n") <= BLOCK_SETS) & (F.col("g") <= BLOCK_GRAMS)
    grams, count = whole.where(small).agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-int(grams) // BLOCK_GRAMS), -(-int(count) // BLOCK_SETS))
    number = F.ceil(F.greatest(F.col("held.n") / BLOCK_SETS, F.col("held.g") / BLOCK_GRAMS)).cast("int")
    large = shared.saved(held.alias("held").join(whole.where(~small).select(F.col("component").alias("c")), F.col("component") == F.col("c")).select("c", F.col("band").alias("at"), number.alias("blocks")), "shingle-large")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    names = large.select("c").distinct().select("c", each.alias("s"))
    one = placed.join(names, (F.col("component") == F.col("c")) & (F.col("salt") == F.col("s")), "left_anti")
    one = one.select("set_id", F.concat(F.lit("all:"), F.pmod(F.xxhash64("component"), F.lit(tasks))).alias("task"), F.lit(0).alias("side"), F.col("component").alias("cluster"))
    cut = placed
    for name, shift in (("here", 0), ("below", -1), ("above", 1)):
        other = large.select(F.col("c").alias(f"c_{name}"), F.col("at").alias(f"at_{name}"), F.col("blocks").alias(name), each.alias(f"s_{name}"))
        cut = cut.join(other, (F.col("component") == F.col(f"c_{name}")) & (F.col("band") + shift == F.col(f"at_{name}")) & (F.col("salt") == F.col(f"s_{name}")), "left" if shift else "inner")
    cut = cut.withColumn("i", F.pmod(F.xxhash64("set_id"), F.col("here")).cast("int"))
    meet = lambda a, i, b, j, side: F.struct(F.concat_ws(":", F.col("component"), a, i, b, j).alias("task"), side.cast("int").alias("side"))
    band, i = F.col("band"), F.col("i")
    to = lambda n: F.when(F.col(n).isNotNull(), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    met = F.concat(
        F.transform(to("here"), lambda j: meet(band, F.least(i, j), band, F.greatest(i, j), F.when(i > j, 1).otherwise(0))),
        F.transform(to("above"), lambda j: meet(band, i, band + 1, j, F.lit(0))),
        F.transform(to("below"), lambda j: meet(band - 1, j, band, i, F.lit(1))),
    )
    cut = cut.select("set_id", "component", F.explode(met).alias("m")).select("set_id", "m.task", "m.side", F.col("component").alias("cluster"))
    return one.unionAll(cut).join(sets.select("set_id", "size", "held", "parts"), "set_id")


def links(sets: DataFrame) -> DataFrame:
    """Components (node, component) of the sets of ``survivors`` that are linked with another."""
    heads = sets.select("set_id", F.explode("heads").alias("gram"))
    least = heads.groupBy("gram").agg(F.min("set_id").alias("v"), F.max("set_id").alias("w")).where("v != w").select(F.col("gram").alias("g"), "v")
    clusters = components(heads.join(shared.dealt(least), F.col("gram") == F.col("g")).select(F.col("set_id").alias("u"), "v"))
    met = blocks(sets, clusters).select("task", "side", "cluster", "size", "held", "set_id", F.posexplode("parts").alias("fragment", "grams"))

    def count(table: pa.Table) -> pa.Table:
        """Partial overlaps in one fragment, packed: steps of the sorted pairs, and counts; sets in order of their ids."""
        table = table.combine_chunks().sort_by("set_id")
        get = lambda c: table.column(c).to_numpy()
        lists = table.column("grams").combine_chunks()
        keys, sums = partial_overlaps(get("cluster"), get("side"), get("size"), get("held"), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy())
        first = table.column("fragment")[0].as_py() == 0
        sets = [get(c).astype(np.int64).tobytes() if first else None for c in ("set_id", "size")]
        steps, sums = np.diff(keys, prepend=0), sums.astype(np.uint32 if sums.max(initial=0) > 0xFFFF else np.uint16)
        steps = steps.astype(np.int64 if steps.max(initial=0) >= 1 << 31 else np.int32)
        return pa.table({"task": table.column("task").slice(0, 1), "ids": pa.array(sets[:1], pa.binary()), "sizes": pa.array(sets[1:], pa.binary()), "steps": pa.array([steps.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    def add(table: pa.Table) -> pa.Table:
        """Sums of all fragments; a spanning star of each component of the linked sets."""
        rows = table.to_pylist()
        ids, size = (np.frombuffer(next(r[c] for r in rows if r[c] is not None), np.int64) for c in ("ids", "sizes"))
        unpack = lambda raw, n, kinds: np.frombuffer(raw, kinds[len(raw) // n]).astype(np.int64)
        found = [(np.cumsum(unpack(r["steps"], r["n"], {4: np.int32, 8: np.int64})), unpack(r["sums"], r["n"], {2: np.uint16, 4: np.uint32})) for r in rows if r["n"]]
        label = local_components(len(ids), *linked_pairs(size, found))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": ids[moved], "v": ids[label[moved]]})

    counted = met.groupBy("task", "fragment").applyInArrow(count, "task string, ids binary, sizes binary, steps binary, sums binary, n long")
    return components(counted.groupBy("task").applyInArrow(add, "u long, v long"))


def classes(docs: DataFrame, size: int, frequent: float) -> DataFrame:
    """doc_id, hash of the text, n_shingles and class of every document; documents without a shingle have none."""
    rows = docs.count()
    known = shared.saved(catalogue(docs, size, min(1.0, SAMPLE / max(rows, 1))), "shingle-sets")
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    count = max(LEAST_FRAGMENTS, -(-total // FRAGMENT_GRAMS))
    parts = fragments(docs, size, count, very_frequent(known, frequent), much_copied(known, rows))
    sets, path = shared.saved_at(survivors(shared_grams(parts, count), count), "shingle-survivors")
    groups = links(sets)
    shared.remove(docs.sparkSession, path)
    return known.join(groups, F.col("set_id") == F.col("node"), "left").select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id")).alias("class"))


def link_documents(docs: DataFrame, size: int = SHINGLE, frequent: float = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document."""
    classed = classes(docs, size, frequent)
    least = classed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).withColumnRenamed("class", "c")
    return classed.join(shared.dealt(least), F.col("class") == F.col("c"), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, frequent: float = FREQUENT) -> DataFrame:
    """One row of ``docs`` of each group of linked documents: that of the least doc_id (nulls last), then text hash.

    Rows are told apart by doc_id and text, so a doc_id that names several texts loses only those that are copies.  Of
    rows equal in both the least by all columns stays.  Documents without a shingle are linked with nothing and stay.
    """
    classed = classes(docs, size, frequent).where("class is not null").select("class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("key"))
    best = classed.groupBy("class").agg(F.min("key").alias("best")).withColumnRenamed("class", "c")
    judged = shared.saved(classed.join(shared.dealt(best), F.col("class") == F.col("c")).select("key.doc_id", "key.mark", (F.col("key") == F.col("best")).alias("stays")), "near-copies")
    own = F.col("doc_id").eqNullSafe(F.col("__copy_id")) & (F.xxhash64("text") == F.col("__copy_mark"))
    named = lambda df: df.select(F.col("doc_id").alias("__copy_id"), F.col("mark").alias("__copy_mark"))
    out = docs.join(named(judged.where("not stays")).distinct(), own, "left_anti")
    twice = shared.saved(named(judged.where("stays").groupBy("doc_id", "mark").count().where("count > 1")), "near-copies-twice")
    if twice.isEmpty():
        return out
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    firsts = out.join(twice, own).groupBy("__copy_id", "__copy_mark").agg(F.min(row).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return out.join(twice, own, "left_anti").unionAll(firsts)
