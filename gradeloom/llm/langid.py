"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrences, one from each end of a window of bytes, give every position a label distribution; a document's
probabilities are the mean over all its positions.  Gates are piecewise linear.  The network is trained here, in
numpy, by backpropagation through time with Adam, on slices of a bounded sample of labelled documents.

Cases: a null text, or one without a letter, is ``und`` with score 0; texts of any length are worked through whole, in
windows whose last one ends with the text; rows that repeat are labelled each; ties of the probabilities go to the
label that sorts first; without any labelled row every document is ``und``, and ``keep_identified``, which has nothing to
judge by then, keeps all rows; an empty table gives an empty table; null doc_ids are not learned from and not held out;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rowbatch

#: Label of texts without letters, hidden units a direction, bytes of a window, windows worked through together.
UNKNOWN, HIDDEN, WINDOW, LANES = "und", 8, 96, 1024
#: Bounds of the training sample: documents a label, characters of each, labels (the most frequent ones).
SAMPLE, SLICE, LABELS = 400, 1500, 256
STEPS, BATCH, TRAIN_WINDOW, RATE = 300, 192, 40, 0.02


@dataclass
class Net:
    """For each direction: input terms (3h x 256) and recurrence (3h x h), rows z, r, new; output (k x 2h) and bias (k)."""

    labels: list[str]
    weights: list[np.ndarray]

    @staticmethod
    def new(labels: list[str], rng: np.random.Generator) -> Net:
        h, weights = HIDDEN, []
        for _ in range(2):
            weights += [rng.normal(0, 0.4, (3 * h, 256)), rng.normal(0, 0.3, (3 * h, h))]
            weights[-2][: 2 * h] += 0.5
        weights += [rng.normal(0, 0.3, (len(labels), 2 * h)), np.zeros(len(labels))]
        return Net(labels, [w.astype(np.float32) for w in weights])


def run_direction(x: np.ndarray, terms: np.ndarray, rec: np.ndarray, out: np.ndarray, back: bool, tape: list | None = None) -> None:
    """Fills ``out`` (t, h, b) with the states over bytes x (t, b), each after its own byte was read.

    Lanes lie along the last axis, so that every operation runs over contiguous rows; without a tape all steps share
    their buffers.
    """
    h, lanes = HIDDEN, x.shape[1]
    state = np.zeros((h, lanes), np.float32)
    raw, past = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
    for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
        np.take(terms, x[t], axis=1, out=raw, mode="clip")
        np.matmul(rec, state, out=past)
        gate, new, q = raw[: 2 * h], raw[2 * h :], past[2 * h :]
        gate += past[: 2 * h]
        np.maximum(gate, 0, out=gate)
        np.minimum(gate, 1, out=gate)
        if tape is not None:
            tape.append((t, state, gate.copy(), q.copy()))
        q *= gate[h:]
        new += q
        np.maximum(new, -1, out=new)
        np.minimum(new, 1, out=new)
        if tape is not None:
            tape[-1] += (new.copy(),)
        step = out[t]
        np.subtract(state, new, out=step)
        step *= gate[:h]
        step += new
        state = step


def probabilities(x: np.ndarray, net: Net, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each position (t, k, b), and the states below them (t, 2h, b)."""
    w, h = net.weights, HIDDEN
    states = np.empty((len(x), 2 * h, x.shape[1]), np.float32)
    run_direction(x, w[0], w[1], states[:, :h], False, tapes and tapes[0])
    run_direction(x, w[2], w[3], states[:, h:], True, tapes and tapes[1])
    p = np.matmul(w[4], states)
    p += w[5][:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p, states


def gradients(x: np.ndarray, y: np.ndarray, net: Net) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross entropy over all positions, by backpropagation through time, and its value."""
    h, w, tapes = HIDDEN, net.weights, ([], [])
    p, states = probabilities(x, net, tapes)
    lanes = np.arange(x.shape[1])
    loss = -float(np.log(np.maximum(p[:, y, lanes], 1e-9)).mean())
    d = p / x.size
    d[:, y, lanes] -= np.float32(1 / x.size)
    read = x.reshape(-1)
    grads: list[np.ndarray] = []
    for side, tape in enumerate(tapes):
        rec = w[2 * side + 1]
        above = np.matmul(w[4][:, side * h : side * h + h].T, d)
        d_terms, d_rec = np.empty((len(x), 3 * h, x.shape[1]), np.float32), np.zeros_like(rec)
        carried = np.zeros((h, x.shape[1]), np.float32)
        for t, state, gate, q, new in reversed(tape):
            dh = above[t] + carried
            z, r = gate[:h], gate[h:]
            here = d_terms[t]
            here[2 * h :] = dh * (1 - z) * (np.abs(new) < 1)
            here[:h] = dh * (state - new)
            here[h : 2 * h] = here[2 * h :] * q
            here[: 2 * h] *= (gate > 0) & (gate < 1)
            back = here.copy()
            back[2 * h :] *= r
            d_rec += back @ state.T
            carried = dh * z + rec.T @ back
        rows = d_terms.transpose(1, 0, 2).reshape(3 * h, -1)
        grads += [np.stack([np.bincount(read, row, 256) for row in rows]).astype(rec.dtype), d_rec]
    return [*grads, np.matmul(d, states.transpose(0, 2, 1)).sum(0), d.sum((0, 2))], loss


def train(samples: dict[str, list[bytes]], steps: int = STEPS, seed: int = 7) -> Net | None:
    """A network for the labels of ``samples``; every label is drawn equally often."""
    samples = {k: [s for s in v if s] for k, v in samples.items()}
    labels = sorted(k for k, v in samples.items() if v)
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = Net.new(labels, rng)
    mean = [np.zeros_like(w) for w in net.weights]
    square = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        y = rng.integers(len(labels), size=BATCH)
        x = np.full((TRAIN_WINDOW, BATCH), 32, np.uint8)
        for lane, label in enumerate(y.tolist()):
            texts = samples[labels[label]]
            text = texts[int(rng.integers(len(texts)))]
            at = int(rng.integers(max(1, len(text) - TRAIN_WINDOW + 1)))
            got = text[at : at + TRAIN_WINDOW]
            x[: len(got), lane] = np.frombuffer(got, np.uint8)
        grads, _ = gradients(x, y, net)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.01 * (g * g - square[i])
            net.weights[i] -= (rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label_texts(data: np.ndarray, offsets: np.ndarray, net: Net) -> np.ndarray:
    """Pooled label probabilities (texts x labels); zeros for texts without bytes."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    base = offsets[:-1][owner]
    wanted = base + number * WINDOW
    start = np.minimum(wanted, np.maximum(base, base + sizes[owner] - WINDOW))
    skip, end = wanted - start, np.minimum(sizes[owner] - (start - base), WINDOW)
    total = np.zeros((len(sizes), len(net.labels)))
    place = np.arange(WINDOW)[:, None]
    padded = np.append(data, np.full(WINDOW, 32, np.uint8))
    for at in range(0, len(owner), LANES):
        some = slice(at, at + LANES)
        x = padded[start[some][None, :] + place]
        x[place >= end[some][None, :]] = 32
        p, _ = probabilities(x, net)
        whole = (skip[some] == 0) & (end[some] == WINDOW)
        pooled = p.sum(axis=0).T.copy()
        part = np.flatnonzero(~whole)
        if len(part):
            counted = (place >= skip[some][None, part]) & (place < end[some][None, part])
            pooled[part] = np.einsum("tkb,tb->bk", p[:, :, part], counted)
        for k in range(pooled.shape[1]):
            total[:, k] += np.bincount(owner[some], weights=pooled[:, k], minlength=len(sizes))
    return total / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> Net | None:
    """Trains on slices of SAMPLE documents a label, the least by a hash of doc_id and text; held-out rows take no part.

    One aggregate counts the labels.  Then a scan keeps the lowest part of the hashes of each, about twice the sample,
    which alone is ranked.  What comes to the driver is bounded by SAMPLE and LABELS, whatever the table's size.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    order = F.xxhash64("doc_id", "text")
    at = F.pmod(order, F.greatest(F.length("text") - SLICE, F.lit(1)).cast("long")).cast("int") + 1
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).collect()
    if not counts:
        return None
    top = 2**63 - 1
    upto = F.create_map(*(F.lit(v) for r in counts for v in (r.lang, min(top, top * 2 * SAMPLE // r.n))))
    low = known.where(order.bitwiseAND(F.lit(top)) <= upto[F.col("lang")])
    sliced = low.select("lang", order.bitwiseAND(F.lit(top)).alias("o"), F.col("text").substr(at, F.lit(SLICE)).alias("text"))
    ranked = sliced.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("o", "text"))).where(F.col("place") <= SAMPLE)
    samples: dict[str, list[bytes]] = {}
    for r in ranked.collect():
        samples.setdefault(r.lang, []).append(r.text.encode("utf-8"))
    return train({k: sorted(v) for k, v in samples.items()})


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = regex.compile(r"\p{L}")
        for batch in rowbatch.small(batches, "text"):
            lettered = np.array([t is not None and letter.search(t) is not None for t in batch.column("text").to_pylist()], bool)
            if net is None:
                names, score = [UNKNOWN] * len(lettered), np.zeros(len(lettered))
            else:
                p = label_texts(*rowbatch.text_bytes(batch.column("text")), net)
                best = p.argmax(axis=1)
                names = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
                score = np.where(lettered, np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Net | None, least_score: float) -> DataFrame:
    """The rows of ``docs`` with a label of at least ``least_score``, unchanged; each row is judged by its own text.

    Rows without a letter go too.  Without a network all rows stay.
    """
    if net is None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = regex.compile(r"\p{L}")
        for batch in rowbatch.small(batches, "text"):
            kept = np.array([t is not None and letter.search(t) is not None for t in batch.column("text").to_pylist()], bool)
            kept &= label_texts(*rowbatch.text_bytes(batch.column("text")), net).max(axis=1) >= least_score
            yield batch.filter(pa.array(kept)).select(names)

    return docs.mapInArrow(run, docs.schema)
