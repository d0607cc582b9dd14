"""One large JSON array of objects, read by many tasks.

Spark's text source splits a file into blocks at any byte and cuts them at closing braces.  Whether a block starts
inside a string, and how deep, depends on all before it; but what it changes can be told without knowing that: its
number of quotes, and its brackets counted for either start.  A first pass takes these few numbers of each block, the driver adds
them up in order, and a second pass then cuts every block at its records.  What lies before a block's first whole record and
behind its last is joined with its neighbours' and cut again.

Anything between records but one comma and white space, or a missing end, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
PIECES = "path string, block long, at long, part int, text string"
RECORD, HEAD, TAIL, MIDDLE = range(4)


def structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that start or end a string; places and signs of all brackets."""
    quotes = np.flatnonzero(raw == 34)
    plain = np.flatnonzero(raw != 92)
    before = np.searchsorted(plain, quotes)
    last = np.where(before > 0, plain[np.maximum(before - 1, 0)], -1) if len(plain) else np.full(len(quotes), -1)
    quotes = quotes[(quotes - last - 1) % 2 == 0]  # an odd run of backslashes before it escapes a quote
    brackets = np.flatnonzero(np.isin(raw, _OPEN + _CLOSE))
    return quotes, brackets, np.where(np.isin(raw[brackets], _OPEN), 1, -1)


def change(raw: np.ndarray) -> tuple[int, int, int]:
    """Whether a block flips between inside and outside of strings, and its change of depth if it starts outside, or inside."""
    quotes, brackets, signs = structure(raw)
    odd = np.searchsorted(quotes, brackets) % 2
    return len(quotes) % 2, int(signs[odd == 0].sum()), int(signs[odd == 1].sum())


def cut(raw: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the records that lie in a block as a whole."""
    quotes, brackets, signs = structure(raw)
    outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
    brackets, signs = brackets[outside], signs[outside]
    level = depth + np.cumsum(signs)
    starts = brackets[(signs > 0) & (level == 2) & (raw[brackets] == _OPEN[0])]
    ends = brackets[(signs < 0) & (level == 1) & (raw[brackets] == _CLOSE[0])] + 1
    if len(starts) and len(ends):
        ends = ends[ends > starts[0]]
        starts = starts[: len(ends)]
    return starts[: len(ends)], ends[: len(starts)]


def checked(path: str, gap: bytes, want: bytes) -> None:
    if b"".join(gap.split()) != want:
        raise ValueError(f"unexpected text between records of {path}: {gap[:80]!r}")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace, with its file and block."""
    meta = {"path": "file_path", "block": "file_block_start"}
    return spark.read.option("lineSep", "}").text(path).select(*(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()), "value")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """File, start and text of each block, with a brace behind every part: one too many at the end of a file."""
    now, held = None, []
    for batch in batches:
        values = batch.column("value").cast(pa.binary()).to_pylist()
        for key, value in zip(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()), values):
            if key != now:
                if now is not None:
                    yield *now, b"".join(held)
                now, held = key, []
            held += [value, b"}"]
    if now is not None:
        yield *now, b"".join(held)


def states(texts: DataFrame) -> dict[str, dict[int, tuple[bool, int]]]:
    """Whether each block of each file starts inside a string, and how deep: four numbers a block reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, raw in whole(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "block", "flips", "outside", "inside"), (path, block, *change(np.frombuffer(raw, np.uint8)))))])

    found = texts.mapInArrow(run, "path string, block long, flips long, outside long, inside long").collect()
    out: dict[str, dict[int, tuple[bool, int]]] = {}
    for path in {r.path for r in found}:
        state, depth, out[path] = False, 0, {}
        for r in sorted((r for r in found if r.path == path), key=lambda r: r.block):
            out[path][r.block] = state, depth
            depth += r.inside if state else r.outside
            state ^= bool(r.flips)
        if state or depth != -1:  # the brace too many
            raise ValueError(f"unterminated object or array in {path}")
    return out


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, text) of every object of the arrays under ``path``; in order of these three."""
    texts = blocks(spark, path)
    known = spark.sparkContext.broadcast(states(texts))
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, raw in whole(batches):
            raw = raw[:-1] if block == max(known.value[path]) else raw
            starts, ends = cut(np.frombuffer(raw, np.uint8), *known.value[path][block])
            for a, b in zip(ends[:-1], starts[1:]):
                checked(path, raw[a:b], b",")
            rows = [(path, block, int(a), RECORD, raw[a:b].decode()) for a, b in zip(starts, ends)]
            around = [(HEAD, raw[: starts[0]]), (TAIL, raw[ends[-1] :])] if len(starts) else [(MIDDLE, raw)]
            rows += [(path, block, 0, part, text.decode()) for part, text in around]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("part", pa.int32()), ("text", pa.string())]))

    pieces = texts.mapInArrow(run, PIECES)
    # Two pieces a block at most: a tail, blocks without a whole record, and the next head belong together.
    order = W.partitionBy("path").orderBy("block", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = pieces.where(F.col("part") != RECORD).withColumn("gap", F.sum((F.col("part") == TAIL).cast("long")).over(order)).withColumn("last", F.max("gap").over(W.partitionBy("path")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"]), "")
    gaps = rest.groupBy("path", "gap", "last").agg(F.min("block").alias("block"), joined.alias("text"))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["text"].encode()
                starts, ends = cut(np.frombuffer(raw, np.uint8), False, 0 if row["gap"] == 0 else 1)
                edges = [0, *(int(x) for pair in zip(starts, ends) for x in pair), len(raw)]
                for i in range(0, len(edges), 2):
                    start, end = row["gap"] == 0 and i == 0, row["gap"] == row["last"] and i == len(edges) - 2
                    checked(row["path"], raw[edges[i] : edges[i + 1]], b"[" * start + b"]" * end or b",")
                at = -(1 << 40) if row["gap"] == 0 else 1 << 40
                rows = [{"path": row["path"], "block": row["block"], "at": at + int(a), "text": raw[a:b].decode()} for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("text", pa.string())]))

    return pieces.where(F.col("part") == RECORD).drop("part").unionByName(gaps.mapInArrow(between, "path string, block long, at long, text string"))
