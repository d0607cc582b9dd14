"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash runs over the hashes of two successive lines.  In each of ``PHASES`` gradings a chunk ends after each
line where the hash's part for that grading is even, so boundaries depend on nearby lines alone and survive shifts, and
a passage of few lines has in one grading or another a chunk that lies inside it.  A chunk of two lines or more that
occurs again anywhere, in any grading, is removed everywhere but at its first place (lowest doc_id, then position),
after its bytes have been compared with those of the first.  Lines go that any such chunk covers.

Cases: a null text stays null; an empty text is one empty line and stays; a document all of whose lines go keeps an
empty text; null doc_ids come after all others; rows that repeat a doc_id and its text are one document and share its
fate; an empty table gives an empty table; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: Gradings, bits between their parts of the hash, and lines of the smallest chunk.
PHASES, STRIDE, LEAST_LINES = 8, 4, 2
_TEXT, _KEY, _CHUNKS = "__text", "__key", "__cuts"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the MD5: any engine can compute it."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def key_of(doc_id: str, text: str) -> Column:
    """Orders documents by doc_id, nulls last; rows that repeat id and text have one key."""
    return F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"))


def chunk_bounds(docs: DataFrame) -> DataFrame:
    """``docs`` (key, text) with ``at``: the different (start, n) of all chunks, in lines.

    Arrays that lambdas index are columns with several uses, which Catalyst doesn't inline into the lambdas.
    """
    lines = docs.select(_KEY, F.split(_TEXT, "\n", -1).alias("lines"))
    hashed = lines.where(F.size("lines") >= LEAST_LINES).select(_KEY, "lines", F.transform("lines", line_hash).alias("lh"))
    rolled = hashed.select(_KEY, "lines", F.transform("lh", lambda x, i: x + 31 * F.coalesce(F.get("lh", i - 1), F.lit(0))).alias("r"))
    ends = lambda p: F.filter(F.transform("r", lambda x, i: F.when(F.shiftright(x, STRIDE * p) % 2 == 0, i + 1)), lambda e: e.isNotNull() & (e < F.size("lines")))
    ended = rolled.select(_KEY, "lines", *(ends(p).alias(f"e{p}") for p in range(PHASES)))
    zero, size = F.array(F.lit(0)), F.array(F.size("lines"))
    cut = lambda p: F.zip_with(F.concat(zero, f"e{p}"), F.concat(f"e{p}", size), lambda b, e: F.struct(b.alias("start"), (e - b).alias("n")))
    return ended.select(_KEY, "lines", F.array_distinct(F.concat(*(cut(p) for p in range(PHASES)))).alias("at"))


def chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["n"]), "\n")


def repeated(docs: DataFrame) -> DataFrame:
    """A row a document with repeated chunks: key, and (start, n, hash, whether first) of those that matter, by start."""
    # Exploding a plain column would have Catalyst filter by its size first, which works the chunks out twice.
    found = chunk_bounds(docs).select(_KEY, "lines", F.explode(F.filter("at", lambda c: c["n"] >= LEAST_LINES)).alias("c"))
    chunks = found.select(_KEY, F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.xxhash64(chunk_text(F.col("lines"), F.col("c"))).alias("hash"))
    again = chunks.groupBy("hash").agg(F.count("*").alias("times"), F.min(F.struct(_KEY, "start")).alias("first")).where("times > 1")
    spots = chunks.join(shared.dealt(again), "hash").select(_KEY, "start", "n", "hash", (F.struct(_KEY, "start") == F.col("first")).alias("is_first"))
    # One deal by document, which the three steps share.  A later chunk inside another one adds no line to what goes.
    one = spots.repartition(_KEY).distinct()
    before = F.max(F.col("start") + F.col("n")).over(W.partitionBy(_KEY, "is_first").orderBy("start", F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
    outer = one.withColumn("before", before).where(F.col("is_first") | F.col("before").isNull() | (F.col("start") + F.col("n") > F.col("before")))
    return outer.groupBy(_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "n", "hash", "is_first"))).alias(_CHUNKS))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, and ``n_lines_cut``.

    The text is shuffled once, to meet its document's list of chunks; chunks meet as hashes, and only texts of
    repeated chunks are shuffled for the comparison.  A chunk that a third of all rows hold has one partner row in
    each join, a skewed side that adaptive execution splits, and is pre-aggregated before it is counted.
    """
    names = [c for c in docs.columns if c != "n_lines_cut"]
    keyed = docs.select(key_of(doc_id, text).alias(_KEY), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text).alias(_TEXT))
    flagged = repeated(keyed.select(_KEY, _TEXT).where(F.col(_TEXT).isNotNull()))
    marked = shared.saved(keyed.select(_KEY, "row").join(flagged, _KEY, "left"), "line-chunks")

    spots = marked.where(F.col(_CHUNKS).isNotNull()).select(_KEY, F.split(f"row.{text}", "\n", -1).alias("lines"), F.explode(_CHUNKS).alias("c"))
    spots = spots.select(_KEY, "c", chunk_text(F.col("lines"), F.col("c")).alias("bytes"))
    first = spots.where("c.is_first").dropDuplicates(["c"]).select(F.col("c.hash").alias("hash"), F.col("bytes").alias("first_bytes"))
    other = spots.where("not c.is_first").join(first, F.col("c.hash") == F.col("hash"))
    unequal = shared.saved(other.where("bytes != first_bytes").select(_KEY, F.col("c.start").alias("start")).distinct().groupBy(_KEY).agg(F.collect_list("start").alias("unequal")), "line-chunks-unequal")
    # Different bytes of one 64-bit hash: as good as never, and then they stay.
    if unequal.isEmpty():
        cuts = marked.select("row", F.filter(F.coalesce(_CHUNKS, F.array()), lambda c: ~c["is_first"]).alias("cut"))
    else:
        cuts = marked.join(unequal, _KEY, "left").select("row", F.filter(F.coalesce(_CHUNKS, F.array()), lambda c: ~c["is_first"] & ~F.array_contains(F.coalesce("unequal", F.array().cast("array<int>")), c["start"])).alias("cut"))

    gone = F.array_distinct(F.flatten(F.transform("cut", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    split = cuts.select("row", F.when(F.size("cut") > 0, F.split(f"row.{text}", "\n", -1)).alias("lines"), F.when(F.size("cut") > 0, gone).alias("gone"))
    left = split.select("row", "lines", "gone", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone").alias("left"))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    whole = F.col(f"row.{text}")
    count = F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long")
    return left.select(*(F.when(F.col("gone").isNull(), whole).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), count.alias("n_lines_cut"))
