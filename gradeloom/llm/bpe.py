"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the pre-token pattern is encoded on its own.  The parts of all distinct pre-tokens of a batch form
linked lists over one byte array.  Waiting merges lie in buckets, one per merge rank, that hold list positions; a
three-level bitmap over the ranks names the buckets that hold anything, so the next rank is three find-first-set steps
away whatever the length of a pre-token.  A popped bucket's merges are applied to all pre-tokens at once.  An entry
whose position has merged or changed its rank since is stale and skipped.  Lists never touch, and the lowest rank of
the queue is the lowest of every list that holds it, so each list sees the order of merges it would see alone.

Cases: a null text is an empty text; an empty text has no ids and decodes to no bytes; repeated rows are encoded
each; an empty table gives an empty table; columns beside the text pass through, and the output columns ``ids`` and
``decoded`` replace columns of these names.  A long text is worked through in slices, so memory beyond its own bytes
and ids stays bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import rowbatch, wordhash

#: The pattern for which pre-tokens are found by array operations; others go through the regex library.
CLASSED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes whose distinct pre-tokens are encoded together, and characters split at a time.
BATCH_BYTES, SLICE = 4 << 20, 1 << 18
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by rank; pops all positions of the lowest rank."""

    def __init__(self, size: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def push(self, ranks: list[int], positions: list[int]) -> None:
        for rank, pos in zip(ranks, positions):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.put(rank, [pos])
            else:
                bucket.append(pos)

    def pop(self) -> tuple[int, list[int]]:
        a = (self.top & -self.top).bit_length() - 1
        bits = self.mid[a]
        b = (a << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[b]
        rank = (b << 6) | ((bits & -bits).bit_length() - 1)
        self.low[b] = bits & (bits - 1)
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(len(every), _OTHER, np.uint8)
    for what, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            out[m.start() : m.end()] = what
    return out


def classed_starts(text: str) -> np.ndarray:
    """Where the matches of CLASSED start in a text, as code point positions."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, kind = len(cp), char_classes()[cp]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    # The last of a run of spaces before something else: joins what follows if it is a blank, else stands alone.
    tail = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE))
    start[tail] = True
    blank = tail[cp[tail] == 32]
    start[blank + 1] = False
    # An apostrophe that starts a match takes some letters with it.
    mark = np.flatnonzero((cp[:-1] == 39) & (kind[1:] == _LETTER))
    mark = mark[start[mark]]
    if len(mark):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        one, two = pad[mark + 1], pad[mark + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for got, size in ((mark[single], 2), (mark[double], 3)):
            start[got + 1] = False
            rest = got + size
            rest = rest[rest < n]
            start[rest] = True
    return np.flatnonzero(start)


def equal(a: np.ndarray, starts: np.ndarray, counts: np.ndarray, b: np.ndarray, other_starts: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
    """Whether ranges of two buffers hold the same bytes, pair by pair."""
    out = np.zeros(len(starts), bool)
    some, at = np.flatnonzero(counts == other_counts), 0
    while at < len(some):  # bounded numbers of bytes at a time; a longer pair stands alone
        to = at + max(1, int(np.searchsorted(np.cumsum(counts[some[at : at + SLICE]]), SLICE, "right")))
        now = some[at:to]
        size = counts[now]
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begin, size)
        differ = a[np.repeat(starts[now], size) + inside] != b[np.repeat(other_starts[now], size) + inside]
        wrong = np.append(0, np.cumsum(differ))
        out[now] = wrong[begin + size] == wrong[begin]
        at = to
    return out


def alike(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first range of each group of ranges with equal bytes, and every range's group.

    Groups are found by hash and compared byte by byte with their first; ranges that differ from it though their hash
    is equal are groups of their own.
    """
    keys, first, which = np.unique(wordhash.ranges(data, start, stop), return_index=True, return_inverse=True)
    size = stop - start
    odd = np.flatnonzero(~equal(data, start, size, data, start[first[which]], size[first[which]]))
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([keys, np.zeros(len(odd), np.uint64)]), np.concatenate([first, odd]), which


def pieces(texts: list[str], pattern: str) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(number of the text, some bytes, ends of the pre-tokens in them), in order."""
    for i, text in enumerate(texts):
        if pattern != CLASSED:
            sizes = [len(m.group().encode("utf-8")) for m in regex.finditer(pattern, text)]
            yield i, text.encode("utf-8"), np.cumsum(sizes, dtype=np.int64)
            continue
        at = 0
        while at < len(text):
            some = text[at : at + SLICE]
            starts = classed_starts(some)
            if at + len(some) < len(text):
                # The last matches may go on beyond the slice: leave them for the next, if any match is left.
                if len(starts) < 4:
                    some = text[at:]
                    starts = classed_starts(some)
                else:
                    some = some[: starts[-3]]
                    starts = starts[:-3]
            raw = some.encode("utf-8")
            if len(raw) != len(some):
                lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                starts = np.flatnonzero(lead)[starts]
            yield i, raw, np.append(starts[1:], len(raw))
            at += len(some)


def pretokens(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, starts and ends of their pre-tokens, and each one's text."""
    owners, raws, ends, base = [], [], [], 0
    for i, raw, stops in pieces(texts, pattern):
        raws.append(raw)
        ends.append(stops + base)
        owners.append(np.full(len(stops), i, np.int32))
        base += len(raw)
    if not base:
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    stop = np.concatenate(ends)
    return np.frombuffer(b"".join(raws), np.uint8), np.append(0, stop[:-1]), stop, np.concatenate(owners)


class Codec:
    """Encodes and decodes by one set of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size, self.pattern = size, pattern
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        whole = wordhash.ranges(self.table, self.starts, self.starts + self.lengths)
        order = np.argsort(whole)
        self.whole_keys, self.whole_ids = whole[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what two parts make together, -1 for none; a part of -1 is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge(self, data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens whose bytes lie one after another, and each one's number of ids."""
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(counts), np.int64)
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        part = np.append(self.byte_ids[data], np.int32(-1))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(counts)
        after[ends[counts > 0] - 1] = n  # n: nothing there
        before[(ends - counts)[counts > 0]] = n
        waiting = np.full(n + 1, -1, np.int32)
        waiting[:n] = self.rank(part[:n], part[after[:n]])
        alive = np.ones(n, bool)
        queue = RankQueue(self.size)
        first = np.flatnonzero(waiting >= 0)
        first = first[np.argsort(waiting[first], kind="stable")]
        edges = np.flatnonzero(np.diff(waiting[first], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(first)]):
            queue.put(int(waiting[first[a]]), first[a:b].tolist())
        while queue.top:
            rank, positions = queue.pop()
            at = np.array(positions, np.int32)
            at = at[waiting[at] == rank]
            if len(at) > 1:
                at.sort()
                kin = owner[at[1:]] == owner[at[:-1]]
                if kin.any():
                    at = self.without_clash(rank, at, part, after, before, owner, queue)
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            part[at] = rank
            alive[gone] = False
            waiting[gone] = -1
            after[at] = end
            before[end] = at
            left = before[at]
            near = np.concatenate([at, left])
            new = self.rank(part[near], part[np.concatenate([end, at])])
            waiting[near] = new
            before[n], part[n], waiting[n] = n, -1, -1
            keep = new >= 0
            queue.push(new[keep].tolist(), near[keep].tolist())
        return part[:n][alive], np.bincount(owner[alive], minlength=len(counts))

    def without_clash(self, rank: int, at: np.ndarray, part: np.ndarray, after: np.ndarray, before: np.ndarray, owner: np.ndarray, queue: RankQueue) -> np.ndarray:
        """Of ascending positions of one rank, those whose merges may be applied together; the others wait again.

        Positions that follow one another directly share a part: every second of such a run goes.  If a merge makes a
        pair of this or a lower rank, only the leftmost of that pre-token goes.
        """
        at = at[np.append(True, at[1:] != at[:-1])]
        chained = np.append(False, after[at[:-1]] == at[1:])
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(chained, 0, place))
        odd = (place - head) % 2 == 1
        going, rest = at[~odd], at[odd]
        kin = owner[going[1:]] == owner[going[:-1]]
        shared = np.append(kin, False) | np.append(False, kin)
        some = going[shared]
        if len(some):
            end, left = after[after[some]], before[some]
            made = np.full(len(some), rank, np.int32)
            low = np.zeros(len(some), bool)
            for a, b in ((made, part[end]), (part[left], made), (made, made)):
                got = self.rank(a, b)
                low |= (got >= 0) & (got <= rank)
            if low.any():
                bad = np.isin(owner[going], owner[some[low]]) & np.append(False, kin)
                rest = np.concatenate([rest, going[bad]])
                going = going[~bad]
        if len(rest):
            queue.put(rank, rest.tolist())
        return going

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        data, start, stop, owner = pretokens(texts, self.pattern)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        keys, first, which = alike(data, start, stop)
        counts = (stop - start)[first]
        at = np.searchsorted(self.whole_keys, keys)
        at[at == len(self.whole_keys)] = 0
        known = self.whole_keys[at] == keys
        maybe = np.flatnonzero(known)
        token = self.whole_ids[at[maybe]]
        known[maybe] = equal(data, start[first[maybe]], counts[maybe], self.table, self.starts[token], self.lengths[token])
        size = np.where(known, 0, counts)
        spread = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        made, number = self.merge(data[spread], size)
        number[known] = 1
        ids = np.empty(int(number.sum()), np.int32)
        where = np.cumsum(number) - number
        ids[where[known]] = self.whole_ids[at[known]]
        other = np.ones(len(ids), bool)
        other[where[known]] = False
        ids[other] = made
        each = number[which]
        per_text = np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
        spread = np.repeat(where[which] - (np.cumsum(each) - each), each)
        spread += np.arange(len(spread))
        return ids[spread], per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        parts = []
        for at in range(0, len(ids), SLICE):
            some = ids[at : at + SLICE]
            lengths = self.lengths[some]
            shift = self.starts[some] - (np.cumsum(lengths) - lengths)
            parts.append(self.table[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes())
        return b"".join(parts)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary, from the ids).

    ``vocabulary``: path of a rank file which every executor can read (part of an installed package, or on a shared
    mount).  One narrow pass: no shuffle, and nothing is kept between batches.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in rowbatch.small(batches, text_col, BATCH_BYTES):
            ids, counts = coder.encode([x or "" for x in batch.column(text_col).to_pylist()])
            ends = np.append(0, np.cumsum(counts))
            at = 0
            while at < len(counts):  # smaller batches back, as ids take more room than text
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                decoded = [coder.decode(ids[ends[i] : ends[i + 1]]) for i in range(at, to)]
                lists = pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), pa.array(ids[ends[at] : ends[to]]))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(decoded, pa.binary())], names=[*names, "ids", "decoded"])
                at = to

    return docs.mapInArrow(run, schema)
