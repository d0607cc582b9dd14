"""Quality rules: base text measures, and lines that too many documents of a host share.

Lines are normalised (words joined by one blank, A-Z lower-cased), hashed, and counted per host over its different
documents.  A line found in more than ``line_limit`` of them is dropped; a document that keeps less than
``least_left`` of its words, or fewer than ``least_words``, is depleted and rejected.

Cases: a null text has no words, so it fails the base rules; a null host is a host of its own; rows that repeat are
judged each, and rows of one doc_id count as one document (each row without one as its own), while copies under other
doc_ids count each; a text with no line above the limits loses nothing; an
empty table gives an empty table; further columns are ignored.  Words are runs of bytes other than space, tab, newline,
vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rowbatch, shared, wordhash

LINE_LIMIT, LEAST_LEFT, LEAST_WORDS, WINDOW = 100, 0.5, 50, 3
SYMBOLS = b"#*$%&|<>"
FEATURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<long>"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the lines of all texts with bytes."""
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[full], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[full + 1], breaks]))
    # A newline that ends its text is followed by an empty line at the next text's start: both lists have it in order.
    owner = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, full])
    owner.sort()
    return starts, ends, owner


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of texts that lie one after another in ``data``; line arrays are flat with ``line_text``."""
    n = len(offsets) - 1
    starts, ends, text = wordhash.words(data, offsets)
    out = {"n_words": np.bincount(text, minlength=n)}
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    out["n_symbols"] = _per_text(table[data], offsets)
    table = np.ones(256, bool)
    table[list(wordhash.SPACES)] = False
    table[0x80:0xC0] = False
    out["word_chars"] = _per_text(table[data], offsets)

    plain = wordhash.ranges(data, starts, ends)
    keys, at = wordhash.grams(plain, text, WINDOW)
    mixed = wordhash.scramble(keys + text[at].astype(np.uint64) * np.uint64(wordhash._BASE))
    _, which, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    covered = np.zeros(len(text), bool)
    twice = at[counts[which] > 1]
    for i in range(WINDOW):
        covered[twice + i] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)

    begin, end, owner = _lines(data, offsets)
    first_word = np.searchsorted(starts, begin)
    words_in = np.searchsorted(starts, end) - first_word
    some = words_in > 0
    begin, end, owner, first_word, words_in = begin[some], end[some], owner[some], first_word[some], words_in[some]
    raw = wordhash.scramble(wordhash.ranges(data, begin, end) + owner.astype(np.uint64) * np.uint64(wordhash._BASE))
    _, first = np.unique(raw, return_index=True)
    again = np.ones(len(raw), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)

    folded = wordhash.ranges(data, starts, ends, fold=True)
    out["line"] = wordhash.runs(folded, words_in)
    out["line_words"], out["line_text"] = words_in, owner
    return out


def features(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Base measures and distinct normalised lines (hash, words in all its copies) of every document."""
    source = docs.select("doc_id", "text", F.col(host_col).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowbatch.small(batches, "text"):
            data, offsets = rowbatch.text_bytes(batch.column("text"))
            got = measure(data, offsets)
            n = batch.num_rows
            mixed = got["line_text"].astype(np.uint64)
            order = np.lexsort((got["line"], mixed))
            line, text, words = got["line"][order], got["line_text"][order], got["line_words"][order]
            new = np.ones(len(line), bool)
            new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
            edges = np.flatnonzero(new)
            total = np.add.reduceat(words, edges) if len(edges) else words
            ends = pa.array(np.append(0, np.cumsum(np.bincount(text[edges], minlength=n))).astype(np.int32))
            columns = [batch.column("doc_id"), batch.column("host")]
            columns += [pa.array(got[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [pa.ListArray.from_arrays(ends, pa.array(line[edges].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(total.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FEATURES.split(", ")])

    return source.mapInArrow(run, FEATURES)


def verdicts(docs: DataFrame, line_limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS, host_col: str = "source") -> DataFrame:
    """A row a document: the base measures, ``base_failed``, ``n_words_left``, ``n_lines_cut`` and ``kept``.

    The features are saved once, far smaller than the text.  Counting is pre-aggregated, so a line or host that holds
    a third of all rows is a few rows a task; lines above the limit join back as single rows a key, a skewed side that
    adaptive execution splits.
    """
    known = shared.saved(features(docs, host_col).withColumn("row", F.monotonically_increasing_id()), "quality-features")
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row")).alias("document")
    lines = known.select("row", "host", document, F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select("row", "host", "document", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"))
    common = lines.select("host", "line", "document").distinct().groupBy("host", "line").count().where(F.col("count") > line_limit).select(F.col("host").alias("h"), F.col("line").alias("l"))
    cut = lines.join(shared.dealt(common), (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h"))).groupBy("row").agg(F.sum("words").alias("cut"), F.count("*").alias("n_lines_cut"))
    left = F.col("n_words") - F.coalesce("cut", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return known.join(cut, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        left.alias("n_words_left"), F.coalesce("n_lines_cut", F.lit(0)).cast("long").alias("n_lines_cut"),
        (~failed & (left >= least_words) & (left >= least_left * F.col("n_words"))).alias("kept"),
    )
