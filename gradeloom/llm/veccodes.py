"""Vector code compression: each part of a vector becomes the number of the nearest entry of the part's codebook.

Components are integers, floor(SCALE * x).  Codebooks start as the parts of the vectors of the least ids and are moved to the
floor of the mean of their parts for a number of rounds.  The nearest entry is found by exponion search: from the entry
that the part had before, its neighbour entries are scanned by rising distance from it, up to twice the part's own
distance to it.  By the triangle inequality no entry beyond that radius is as near as the one at hand, so all ties are
seen too, and the lower index wins them.  All distances are exact integers: where 64 bits could overflow, Python's.

Each round is one narrow pass that saves rows with their codes, and one that adds up at most entries x dimensions sums a
task; only these sums, a row a codebook component, and the first vectors reach the driver.

Cases: rows go whose vector is null or holds a null or non-finite component (or one beyond the range of a 32-bit
float), and rows whose length isn't the most frequent one that the parts divide (the shorter of two that are equally
frequent), as they can't be cut alike; null ids come after all others; rows that share an id are coded each, and are
taken as first entries in the order of their components; with fewer rows than entries the codebooks are shorter; null
labels are equal; an error beyond 64 bits is the largest 64-bit number; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors worked through at a time.
BATCH = 4096
_LARGEST = (1 << 63) - 1
_FLOAT = 3.4028234663852886e38
#: Sums leave a task as digits to the base 2**32, the last with the sign.
_DIGITS = 5


def integers(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors' integer components, a row each; Python's integers where a component needs more than 62 bits."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, dimension)
    if not flat.size or np.abs(flat).max() < 2.0**62:
        return flat.astype(np.int64)
    return np.array([[int(x) for x in row] for row in flat], object)


def largest(*arrays: np.ndarray) -> int:
    return max([0, *(int(abs(x).max()) for x in arrays if x.size)])


class Codebooks:
    """All entries, as (parts, entries, width) integers, with each entry's neighbours by rising distance from it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.parts, self.size, self.width = entries.shape
        self.high = largest(entries)
        exact = entries if self.fits(self.high) else entries.astype(object)
        gaps = ((exact[:, :, None, :] - exact[:, None, :, :]) ** 2).sum(axis=3)
        order = np.argsort(gaps, axis=2, kind="stable")
        self.entries = exact.reshape(-1, self.width)
        self.near = order.reshape(-1, self.size).astype(np.int32)
        self.gaps = np.take_along_axis(gaps, order, axis=2).reshape(-1, self.size)

    def fits(self, high: int) -> bool:
        """Whether four times a squared distance between components up to ``high`` stays inside 64 bits."""
        return 16 * high * high * self.width <= _LARGEST

    def search(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (n, parts) and squared distances, each search from the entry of ``before``."""
        n = len(vectors)
        x = vectors.reshape(n * self.parts, self.width)
        entries, gaps = self.entries, self.gaps
        if not self.fits(max(self.high, largest(x))):
            x, entries, gaps = x.astype(object), entries.astype(object), gaps.astype(object)
        base = np.tile(np.arange(self.parts) * self.size, n)
        home = base + before.reshape(-1)
        best, least = before.reshape(-1).astype(np.int32), ((x - entries[home]) ** 2).sum(axis=1)
        radius = 4 * least
        going = np.arange(len(x))
        for step in range(self.size):
            going = going[(gaps[home[going], step] <= radius[going]).astype(bool)]
            if not len(going):
                break
            other = self.near[home[going], step]
            distance = ((x[going] - entries[base[going] + other]) ** 2).sum(axis=1)
            won = ((distance < least[going]) | ((distance == least[going]) & (other < best[going]))).astype(bool)
            best[going[won]], least[going[won]] = other[won], distance[won]
        return best.reshape(n, self.parts).astype(np.uint8), least.reshape(n, self.parts)

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Codebooks:
        """Codebooks of the floors of means; ``sums`` by slot: count, sums.  Entries without parts stay."""
        new = self.entries.astype(object)
        for slot, (count, total) in sums.items():
            new[slot] = [t // count for t in total]
        if largest(new) < 1 << 62:
            new = new.astype(np.int64)
        return Codebooks(new.reshape(self.parts, self.size, self.width))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()


def digits(sums: np.ndarray) -> list[np.ndarray]:
    """Integers as digits to the base 2**32, the lowest first; the last one keeps the sign."""
    low = [((sums >> min(32 * i, 63) if sums.dtype != object else sums >> 32 * i) & 0xFFFFFFFF).astype(np.int64) for i in range(_DIGITS - 1)]
    return [*low, (sums >> (63 if sums.dtype != object else 32 * (_DIGITS - 1))).astype(np.int64)]


def coded(rows: DataFrame, books: Codebooks, dimension: int, final: bool = False) -> DataFrame:
    """``rows`` with ``code`` by these codebooks, each search from the code that the row has; ``final``: errors instead of vectors."""
    spread = rows.sparkSession.sparkContext.broadcast(books)
    kept = [f.name for f in rows.schema.fields if f.name != "code" and not (final and f.name == "embedding")]
    schema = rows.select(*kept).schema.add("code", "binary")
    if final:
        schema = schema.add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = spread.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                before = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, books.parts)
                code, distance = books.search(integers(part.column("embedding"), dimension), before)
                columns = [*(part.column(c) for c in kept), pa.array([c.tobytes() for c in code], pa.binary())]
                if final:
                    columns.append(pa.array([min(int(e), _LARGEST) for e in distance.astype(object).sum(axis=1)], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def entry_sums(rows: DataFrame, books: Codebooks, dimension: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the parts at each entry in use, exactly: added up a task, then over all tasks."""
    parts, size, width = books.parts, books.size, books.width
    names = ["place", "n", *(f"d{i}" for i in range(_DIGITS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, room = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64), _LARGEST
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = integers(part.column("embedding"), dimension).reshape(-1, width)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8)
                slot = np.tile(np.arange(parts) * size, part.num_rows) + code
                room -= part.num_rows * largest(x)
                if room < 0 or x.dtype == object:
                    total, x, room = total.astype(object), x.astype(object), 0
                count += np.bincount(slot, minlength=parts * size)
                np.add.at(total, slot, x)
        used = np.flatnonzero(count)
        place = (used[:, None] * width + np.arange(width)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place, np.repeat(count[used], width), *digits(total[used].reshape(-1)))], names=names)

    added = rows.select("embedding", "code").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    got = added.groupBy("place").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    columns = [got.column(c).to_pylist() for c in names]
    found = {place: (n, sum(d << 32 * i for i, d in enumerate(ds))) for place, n, *ds in zip(*columns)}
    return {place // width: (n, [found[place + i][1] for i in range(width)]) for place, (n, _) in found.items() if place % width == 0}


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Rows of vec_id, label, code (a byte a part) and error for each kept row, in a saved table; and the codebooks.

    ``vectors``: vec_id, embedding (array of float or double), label.  At most 256 entries, so that a byte tells one.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > _FLOAT))
    whole = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~bad)
    sizes = whole.groupBy(F.size("embedding").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0))
    most = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    if not most:
        return spark.createDataFrame([], whole.drop("embedding").schema.add("code", "binary").add("error", "long")), None
    dimension = most[0]["size"]
    kept = whole.where(F.size("embedding") == dimension)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column("embedding")
    start = integers(first.combine_chunks(), dimension)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, dimension // parts).transpose(1, 0, 2)))
    rows, held = kept.withColumn("code", F.lit(bytes(parts))), None
    for _ in range(rounds):
        rows, path = shared.saved_at(coded(rows, books, dimension), "vector-codes")
        if held:
            shared.remove(spark, held)
        held = path
        books = books.moved(entry_sums(rows, books, dimension))
    done = shared.saved(coded(rows, books, dimension, final=True), "vector-codes-final")
    if held:
        shared.remove(spark, held)
    return done, books


def codes(vectors: DataFrame) -> DataFrame:
    """Digest columns of a compression: hexadecimal codes, errors, the error of each label, and a hash of the codebooks.

    Label sums are pre-aggregated and come back as one row a label, so a label that holds a third of all rows is a
    skewed key with a single partner row.
    """
    done, books = compress(vectors)
    summed = done.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    per_label = summed.select("l", F.least("s", F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = done.join(shared.dealt(per_label), F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
