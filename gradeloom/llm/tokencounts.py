"""Token counts of texts by heap-and-linked-list byte-pair merging, without making identifiers.

Each pre-token starts as a linked list of the symbols of its bytes, and a heap holds the adjacent pairs that the vocabulary merges, by
rank and place.  The pair of the lowest rank is popped again and again; an entry whose pair has changed since is
stale and skipped.  A merge leaves one symbol less, so the count is the number of bytes less the number of merges.
Each distinct pre-token of a batch is worked through once, and the counts of short ones are remembered up to a bound.

The vocabulary is a JSON file of the tokenizers library with byte-level pre-tokens and BPE merges.  Its added tokens
are found in the raw text first, as that library does unless told otherwise: each is one token, and the text between
them is pre-tokenised by itself.

Cases: a null text is an empty text, which has no bytes and no tokens; repeated rows are counted each; an empty table
gives an empty table; columns beside the text pass through, and ``n_bytes`` and ``n_tokens`` replace columns of these
names.  A long text is cut into pre-tokens in slices; the heap and lists of one pre-token grow with its own length.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe, rowbatch

#: Text bytes whose distinct pre-tokens are counted together; remembered pre-tokens, and the longest of them.
BATCH_BYTES, REMEMBERED, SHORT = 4 << 20, 1 << 18, 48
_PLACE = (1 << 32) - 1


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens by one vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without normaliser, prefix space and further options can be counted")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them can't be counted")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        names = byte_names()
        self.symbols = [vocab[names[b]] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.known: dict[bytes, int] = {}

    def symbols_left(self, raw: bytes) -> int:
        """Bytes of a pre-token less its merges."""
        n = left = len(raw)
        ranks, made = self.ranks, self.made
        symbol = array("q", [self.symbols[b] for b in raw])
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            at, rank = top & _PLACE, top >> 32
            gone = after[at]
            if gone >= n or symbol[at] < 0 or ranks.get(symbol[at] << 32 | symbol[gone]) != rank:
                continue  # merged away, or its pair is another by now
            new = symbol[at] = made[rank]
            symbol[gone] = -1
            end = after[at] = after[gone]
            left -= 1
            if end < n:
                before[end] = at
                rank = ranks.get(new << 32 | symbol[end])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | at)
            start = before[at]
            if start >= 0:
                rank = ranks.get(symbol[start] << 32 | new)
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | start)
        return left

    def number(self, raw: bytes) -> int:
        if len(raw) > SHORT:
            return self.symbols_left(raw)
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[raw] = self.symbols_left(raw)
        return found

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out, between, owner = np.zeros(len(texts), np.int64), texts, None
        if self.added:
            parts = [self.added.split(t) for t in texts]
            sizes = np.array([len(p) for p in parts], np.int64)
            out += sizes - 1
            between, owner = [p for some in parts for p in some], np.repeat(np.arange(len(texts)), sizes)
        data, start, stop, which = bpe.pretokens(between, bpe.CLASSED)
        if not len(start):
            return out
        _, first, group = bpe.alike(data, start, stop)
        raw = data.tobytes()
        each = np.array([self.number(raw[a:b]) for a, b in zip(start[first].tolist(), stop[first].tolist())], np.int64)
        text = which if owner is None else owner[which]
        return out + np.bincount(text, weights=each[group], minlength=len(texts)).astype(np.int64)


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``vocabulary``: path of a file which every executor can read (part of an installed package, or on a shared mount).
    One narrow pass: no shuffle, and nothing but counts of short pre-tokens is kept between batches.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_bytes", "n_tokens")]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in rowbatch.small(batches, text_col, BATCH_BYTES):
            _, offsets = rowbatch.text_bytes(batch.column(text_col))
            numbers = tokens.count([x or "" for x in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(numbers)], names=schema.names)

    return docs.mapInArrow(run, schema)
