"""Substring dedup by sliding sentence spans.

Sentences end at a word that ends in . ! or ? (closing quotes and brackets may follow) and at line breaks.  Every run
of three sentences is hashed, however short; so are runs of two with twenty words or more, and single sentences of
fifty, which passages of few long sentences need.  Equal hashes meet globally.  A sentence goes if any span that covers it occurs first elsewhere: in a document of lower doc_id, or
earlier in its own.

Cases: a null text stays null and an empty one empty; texts of one or two short sentences have no span and stay; null doc_ids come
after all others and count as one; rows that share a doc_id count as one document, so that repeated rows keep what
either keeps; a document all of whose sentences go keeps an empty text; an empty table gives an empty table; further
columns pass through, whatever their names, but for ``n_sentences_cut``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rowbatch, shared, wordhash

#: Runs of so many sentences with so many words at least.
RUNS = ((3, 0), (2, 20), (1, 50))
_ENDS, _CLOSERS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLOSERS[list(b"\"')]}")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, the number of each sentence's first word (and one past the last), sentences' texts."""
    starts, ends, text = wordhash.words(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(1, np.int64), text
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, starts)]
    stop = _ENDS[last] | (_CLOSERS[last] & _ENDS[before])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]]) | (text[1:] != text[:-1])
    stop[-1] = True
    first = np.append(0, np.flatnonzero(stop) + 1)
    return starts, ends, first, text[first[:-1]]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, number of the first sentence in its text, and number of sentences of every span."""
    starts, ends, first, text = sentences(data, offsets)
    word = wordhash.ranges(data, starts, ends)
    inside = np.arange(len(text)) - np.searchsorted(text, text)
    sentence = wordhash.runs(word, np.diff(first)) if len(text) else word
    found = []
    for run, least in RUNS:
        n = len(text) - run + 1
        if n <= 0:
            continue
        a, b = first[:n], first[run : run + n]
        ok = (text[:n] == text[run - 1 :]) & (b - a >= least)
        a, b, at = a[ok], b[ok], np.flatnonzero(ok)
        h = sentence[at]
        for i in range(1, run):
            h = wordhash.mix(h, sentence[at + i])
        found.append((h, text[at], inside[at], np.full(len(at), run)))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def span_rows(docs: DataFrame) -> DataFrame:
    """A row a span: hash, doc_id, mark (tells texts of one doc_id apart), place (4 * first sentence + sentences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text"):
            h, text, at, size = spans(*rowbatch.text_bytes(batch.column("text")))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(take), batch.column("mark").take(take), pa.array((4 * at + size).astype(np.int32))], names=["hash", "doc_id", "mark", "place"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "hash long, doc_id long, mark int, place int")


def cut_sentences(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the sentences ``gone`` (numbers over all texts).

    A sentence's bytes reach to the next one of its text, or to the text's end.
    """
    starts, _, first, text = sentences(data, offsets)
    begin = starts[first[:-1]]
    end = offsets[text + 1].copy()
    same = text[1:] == text[:-1]
    end[:-1][same] = begin[1:][same]
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, begin[gone], 1)
    np.add.at(change, end[gone], -1)
    keep = np.cumsum(change[:-1]) == 0
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated spans removed from ``text``, and ``n_sentences_cut``.

    Spans are shuffled as 24-byte rows, twice: to count them, pre-aggregated, and to meet the repeated ones, which are
    one row a hash, so a passage of a third of all documents is a skewed key with a single partner row.  The text is
    shuffled once.
    """
    names = [c for c in docs.columns if c != "n_sentences_cut"]
    fields = [f for f in docs.schema.fields if f.name != "n_sentences_cut"]
    mark = F.pmod(F.xxhash64(text), F.lit(2**31 - 1)).cast("int")
    source = docs.select(F.col(doc_id).alias("doc_id"), mark.alias("mark"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = span_rows(source)
    again = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").select(F.col("hash").alias("h"), "first_id")
    hits = rows.join(shared.dealt(again), F.col("hash") == F.col("h")).select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), F.struct(F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("hash")).alias("own"), "place").alias("hit"))
    lists = hits.groupBy("hit_id", "hit_mark").agg(F.collect_set("hit").alias("hits")).select("hit_id", "hit_mark", F.col("hits.own").alias("own"), F.col("hits.place").alias("place"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(doc_id).alias("i"), mark.alias("m"), F.col(text).alias("text"))
    joined = packed.join(lists, F.col("i").eqNullSafe(F.col("hit_id")) & (F.col("m") == F.col("hit_mark")), "left").select("row", "own", "place", "text")
    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField("kept", T.StringType()), T.StructField("n_sentences_cut", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text"):
            data, offsets = rowbatch.text_bytes(batch.column("text"))
            owner = sentences(data, offsets)[3]
            start = np.searchsorted(owner, np.arange(batch.num_rows))
            gone = np.zeros(len(owner), bool)
            for i, (own, place) in enumerate(zip(batch.column("own"), batch.column("place"))):
                if not place.is_valid:
                    continue
                seen: dict[int, int] = {}
                some = sorted(zip(place.as_py(), own.as_py()))
                for p, h in some:
                    at, size = start[i] + p // 4, p % 4
                    if h is not None and seen.setdefault(h, p) == p:
                        continue  # the first place of a span whose first document this is
                    gone[at : at + size] = True
            data, ends = cut_sentences(data, offsets, np.flatnonzero(gone))
            raw = data.tobytes()
            kept = [raw[a:b].decode("utf-8") if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("text").is_valid().to_pylist())]
            count = np.bincount(owner[gone], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(count.astype(np.int64))], names=["row", "kept", "n_sentences_cut"])

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), "n_sentences_cut")
