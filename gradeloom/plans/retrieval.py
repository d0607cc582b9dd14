"""Template lookups: answers of known rows with equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import close


def lookup(queries: DataFrame, known: DataFrame, keys: list[str], answer: str, numbers: str | None = None) -> DataFrame:
    """For each query row the answers of known rows with equal keys, with counts: one row an answer.

    ``numbers`` names an array of both sides that must agree as well, number by number, but for a relative 1e-9.
    """
    wide = [*keys, *([numbers] if numbers else []), answer]
    counts = known.where(F.col(answer).isNotNull()).groupBy(*wide).agg(F.count("*").alias("n"))
    if not numbers:
        return queries.join(counts, keys)
    # The first numbers meet by cells that are wide beside the tolerance, and the cells beside; then all are compared.
    cell = lambda x: F.coalesce(F.floor(F.asinh(F.get(x, F.lit(0)).cast("double")) * 1e7), F.lit(-(1 << 62)))
    theirs = counts.withColumnRenamed(numbers, "__numbers").withColumn("__cell", cell(F.col("__numbers")))
    mine = queries.withColumn("__near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell(F.col(numbers)) + i)))
    alike = F.forall(F.arrays_zip(F.col(numbers).alias("a"), F.col("__numbers").alias("b")), lambda p: close(p["a"], p["b"]))
    met = mine.withColumnRenamed("__near", "__cell").join(theirs, [*keys, "__cell"])
    hits = met.where((F.size(numbers) == F.size("__numbers")) & alike)
    return hits.groupBy(*queries.columns, answer).agg(F.sum("n").alias("n"))
