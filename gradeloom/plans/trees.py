"""Extremely randomised regression trees, grown level by level.

All trees see all rows.  At each node every feature gets one threshold, drawn between its least and largest value there by a hash of
(seed, tree, node, feature); the feature whose two sides differ most in the label's mean splits the node.  A level
takes two passes over the rows: one for counts, label sums and the ends of all features at all nodes of all trees, one for
the sums left of the thresholds.  Rows of equal features are summed up first, in a saved table, so their source is read once.
Tasks add up arrays and hand on a row a node; what reaches the driver is the model, bounded by
trees, depth and features.  Any partitioning grows the same trees: gains a row are compared rounded to ten digits, and of equal splits the first feature wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch

#: Settings of the ranker: trees, depth, and rows of a leaf at least.
TREES, DEPTH, LEAF = 300, 8, 3


def fraction(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """A number in [0, 1) that depends on the four alone."""
    h = np.full(np.broadcast(tree, node, feature).shape, seed, np.uint64)
    for part in (tree, node, feature):
        h = (h ^ np.asarray(part, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def best_split(n: np.ndarray, total: np.ndarray, left_n: np.ndarray, left: np.ndarray, leaf: int) -> np.ndarray:
    """The feature that splits each node, -1 for none: (nodes), (nodes), (nodes, features), (nodes, features)."""
    right_n, right = n[..., None] - left_n, total[..., None] - left
    ok = (left_n >= leaf) & (right_n >= leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2 / left_n + right**2 / right_n - (total**2 / n)[..., None]) / n[..., None]
    gain = np.where(ok, np.round(gain, 10), -1.0)  # a row, so that the noise of large sums stays below the digits
    best = gain.argmax(axis=-1)
    return np.where(np.take_along_axis(gain, best[..., None], -1)[..., 0] > 0, best, -1)


@dataclass
class Forest:
    """Trees as arrays by (tree, node), nodes numbered from 1 as in a heap: the splitting feature (-1: a leaf), its threshold, the mean."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The last node of each row in each tree, as far as the trees have grown."""
        trees = np.arange(len(self.feature))[None, :]
        at = np.ones((len(x), len(self.feature)), np.int64)
        while True:
            split = self.feature[trees, at]
            inner = split >= 0
            if not inner.any():
                return at
            value = np.take_along_axis(x, np.maximum(split, 0), axis=1)
            at = np.where(inner, 2 * at + (value > self.threshold[trees, at]), at)

    def predict(self, rows: DataFrame, name: str = "rank_score") -> DataFrame:
        """``rows`` with the mean of all trees' values."""
        spread, schema = rows.sparkSession.sparkContext.broadcast(self), rows.drop(name).schema.add(name, "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = spread.value
            for batch in batches:
                at = forest.nodes(matrix(batch, forest.features))
                mean = forest.value[np.arange(len(forest.value))[None, :], at].mean(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(mean)], names=schema.names)

        return rows.mapInArrow(run, schema)


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.empty((batch.num_rows, 0))


def one_hot(df: DataFrame, kinds: dict[str, list]) -> tuple[DataFrame, list[str]]:
    """Columns of 1 and 0 for each named value of each kind."""
    columns = {f"{c}_{i}": F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for c, values in kinds.items() for i, v in enumerate(values)}
    return df.withColumns(columns), list(columns)


def fit(rows: DataFrame, features: list[str], label: str, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7, times: str | None = None) -> Forest:
    """A forest over ``rows`` without null features or labels; rows with any are left out.  Without rows all trees say 0.

    ``times``: a column that tells how many rows a row stands for.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "tree-rows")
    each = rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("__y"), (F.col(times) if times else F.lit(1)).cast("long").alias("__n")).dropna()
    alike = each.groupBy(*features).agg(F.sum(F.col("__y") * F.col("__n")).alias("__y"), F.sum("__n").cast("double").alias("__n"))
    alike.write.parquet(path)
    known = spark.read.schema(alike.schema).parquet(path)
    width, wide = 2 << depth, len(features)
    forest = Forest(features, np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width)))
    for level in range(depth + 1):
        first, count = 1 << level, 1 << level
        spread = spark.sparkContext.broadcast(forest)

        def placed(batch: pa.RecordBatch, forest: Forest, first=first, count=count) -> tuple[np.ndarray, ...]:
            """Cell (tree, node of this level), row, features, label sum and number of each row in each tree where it has come to this level."""
            x, y, w = matrix(batch, forest.features), batch.column("__y").to_numpy(), batch.column("__n").to_numpy()
            at = forest.nodes(x)
            row, tree = np.nonzero(at >= first)
            return tree * count + at[row, tree] - first, row, x, y, w

        def ends(batches: Iterator[pa.RecordBatch], spread=spread, count=count) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(trees * count), np.zeros(trees * count)
            low, high = np.full((trees * count, wide), np.inf), np.full((trees * count, wide), -np.inf)
            for batch in batches:
                cell, row, x, y, w = placed(batch, spread.value)
                n += np.bincount(cell, weights=w[row], minlength=len(n))
                total += np.bincount(cell, weights=y[row], minlength=len(n))
                np.minimum.at(low, cell, x[row])
                np.maximum.at(high, cell, x[row])
            yield emitted(n > 0, n, total, low, high)

        got = summed(known.mapInArrow(ends, CELLS.format("n double, total double")), ("n", "total"), wide, (F.min, F.max))
        cell, n, total, low, high = got
        tree, node = cell // count, first + cell % count
        forest.value[tree, node] = np.where(n > 0, total / np.maximum(n, 1), 0.0)
        if level == depth or not len(cell):
            break
        cuts = np.full((trees * count, wide), np.nan)
        cuts[cell] = low + (high - low) * fraction(seed, tree[:, None], node[:, None], np.arange(wide)[None, :])
        cuts[cell] = np.where(low < high, cuts[cell], np.nan)
        sent = spark.sparkContext.broadcast(cuts)

        def lefts(batches: Iterator[pa.RecordBatch], spread=spread, sent=sent, count=count) -> Iterator[pa.RecordBatch]:
            n, left_n, left = np.zeros(trees * count), np.zeros((trees * count, wide)), np.zeros((trees * count, wide))
            for batch in batches:
                cell, row, x, y, w = placed(batch, spread.value)
                n += np.bincount(cell, weights=w[row], minlength=len(n))
                goes = x[row] <= sent.value[cell]
                np.add.at(left_n, cell, goes * w[row][:, None])
                np.add.at(left, cell, goes * y[row][:, None])
            yield emitted(n > 0, n, n, left_n, left)

        at, _, _, left_n, left = summed(known.mapInArrow(lefts, CELLS.format("n double, total double")), ("n", "total"), wide, (F.sum, F.sum))
        order = np.searchsorted(cell, at)
        split = best_split(n[order], total[order], left_n, left, leaf)
        tree, node = tree[order], node[order]
        some = split >= 0
        grown = Forest(features, forest.feature.copy(), forest.threshold.copy(), forest.value)
        grown.feature[tree[some], node[some]] = split[some]
        grown.threshold[tree[some], node[some]] = cuts[at[some], split[some]]
        forest = grown
        if not some.any():
            break
    return forest


CELLS = "cell long, {}, a array<double>, b array<double>"


def emitted(some: np.ndarray, n: np.ndarray, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(some)
    columns = [pa.array(at), pa.array(n[at]), pa.array(total[at]), pa.array(list(a[at]), pa.list_(pa.float64())), pa.array(list(b[at]), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "n", "total", "a", "b"])


def summed(cells: DataFrame, sums: tuple[str, ...], wide: int, how: tuple) -> list[np.ndarray]:
    """Cells in order, their sums, and the arrays put together element by element."""
    arrays = [F.array(*(f(F.get(c, F.lit(i))) for i in range(wide))).alias(c) for c, f in zip(("a", "b"), how)]
    got = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in sums), *arrays).toArrow().sort_by("cell")
    flat = [np.array(got.column(c).to_pylist(), float).reshape(-1, wide) for c in ("a", "b")]
    return [got.column("cell").to_numpy(), *(got.column(c).to_numpy() for c in sums), *flat]
