"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's larger (or smaller) neighbours to the least of them all.

    Two aggregates and a join whose one side has a row a node: a centre of very many edges is a skewed key with one
    partner row, and no neighbourhood is ever gathered.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    hooked = both.join(shared.dealt(least), F.col("u") == F.col("w"))
    if large:
        made = hooked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return made.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, component: the least node); nodes without edges are absent."""
    now, path = shared.saved_at(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before or said[0] == 0:
            break
        before = said
        now, next_path = shared.saved_at(_star(_star(now, True), False), "edges")
        shared.remove(edges.sparkSession, path)
        path = next_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
