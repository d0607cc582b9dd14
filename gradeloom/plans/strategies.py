"""Answer strategies over an index of known questions: lookups, thresholds on similarity, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.aggregate import evaluated
from ..operators.vote import majority

#: Thresholds of similarity, in order.
THRESHOLDS = (0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50)


def majority_lookup(rows: DataFrame, entries: DataFrame, keys: list[str], row: str, answer: str, ordinal: str) -> DataFrame:
    """(row, candidate) by the most frequent answer of entries with equal keys; answers are counted before the join."""
    known = entries.withColumn("__key", F.struct(*(F.col(k) for k in keys)))
    best = majority(known, "__key", answer, ordinal).select("__key", F.col("top_answer").alias("candidate"))
    return rows.select(row, F.struct(*(F.col(k) for k in keys)).alias("__mine")).join(best, F.col("__mine") == F.col("__key")).select(row, "candidate")


def nearest_majority(hits: DataFrame, row: str, answer: str, similarity: str, ordinal: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, row, candidate, kept) for every threshold: the most frequent answer of the hits that reach it.

    Counts for all thresholds are conditional sums of one aggregate a row and answer.  Ties: seen first among those kept.
    """
    keep = [F.col(similarity) >= t for t in thresholds]
    counts = hits.groupBy(row, answer).agg(*(c for i, k in enumerate(keep) for c in (F.count_if(k).alias(f"n{i}"), F.min(F.when(k, F.col(ordinal))).alias(f"s{i}"))))
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("seen")) for i, t in enumerate(thresholds)))
    long = counts.select(row, answer, F.explode(each).alias("e")).where("e.n > 0")
    best = long.groupBy("e.threshold", row).agg(F.min(F.struct((-F.col("e.n")).alias("n"), F.col("e.seen").alias("seen"), F.col(answer).alias("a"))).alias("m"), F.sum("e.n").alias("kept"))
    return best.select("threshold", row, F.col("m.a").alias("candidate"), "kept")


def analyze_source(rows: DataFrame, entries: DataFrame, hits: DataFrame, row: str, answer: str, fallback: str, score: Callable[[Column], Column], family: str, lookups: dict[str, list[str]], similarity: str, ordinal: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Evaluates every strategy of one index: lookups by keys, thresholds, the nearest hit, and the best of all hits.

    One row a strategy and family (null: over all).  The best of all hits looks at the gold answer: an upper bound.
    The hits are dealt by row once, and give the answers of all strategies but the lookups in one pass; a row then holds
    its answers as an array, and all are judged together.
    """
    keep = [F.col(similarity) >= t for t in thresholds]
    counts = [c for i, k in enumerate(keep) for c in (F.count_if(k).alias(f"n{i}"), F.min(F.when(k, F.col(ordinal))).alias(f"s{i}"))]
    near = F.max(F.struct(F.col(similarity).alias("s"), (-F.col(ordinal)).alias("o")))
    groups = hits.repartition(row).groupBy(F.col(row).alias("__row"), F.col(answer).alias("__a")).agg(*counts, near.alias("near"), F.min(ordinal).alias("first"))
    judged = rows.join(groups, F.col(row) == F.col("__row")).withColumn("__s", score(F.col("__a")))
    picks = {f"nearest_majority_{t:.2f}": F.min(F.when(F.col(f"n{i}") > 0, F.struct((-F.col(f"n{i}")).alias("n"), F.col(f"s{i}").alias("seen"), F.col("__a").alias("a")))) for i, t in enumerate(thresholds)}
    picks |= {"top1": F.max(F.struct("near", F.col("__a").alias("a"))), "oracle": F.max(F.struct("__s", -F.col("first"), F.col("__a").alias("a")))}
    best = judged.groupBy("__row").agg(*(c.alias(f"b{i}") for i, c in enumerate(picks.values())))
    told, answers = rows.join(best, F.col(row) == F.col("__row"), "left"), {name: F.col(f"b{i}.a") for i, name in enumerate(picks)}
    for i, (name, keys) in enumerate(lookups.items()):
        known = majority(entries.withColumn("__key", F.struct(*(F.col(k) for k in keys))), "__key", answer, ordinal).select(F.col("__key").alias(f"k{i}"), F.col("top_answer").alias(f"l{i}"))
        told, answers[name] = told.join(known, F.struct(*(rows[k] for k in keys)) == F.col(f"k{i}"), "left"), F.col(f"l{i}")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("strategy"), c.alias("__c")) for name, c in answers.items())))
    long = told.select(*(rows[c] for c in rows.columns), each.alias("__e")).select(*rows.columns, "__e.*")
    return evaluated(long, "__c", fallback, score, family, "strategy")


def run_profiles(choices: DataFrame, gold: DataFrame, row: str, chosen: str, score: Callable[[Column], Column]) -> DataFrame:
    """Every profile's choices (profile, row, chosen), scored: a row a profile, and whether it is the best (raw, tens, fewer zeros, name)."""
    out = choices.select("profile", F.col(row).alias("__r"), F.col(chosen).alias("__c"))
    s = gold.join(out, F.col(row) == F.col("__r")).withColumn("__s", score(F.col("__c")))
    sums = s.groupBy("profile").agg(F.count("*").alias("n"), F.sum("__s").alias("raw"), F.count_if(F.col("__s") == 10).alias("tens"), F.count_if(F.col("__s") == 0).alias("zeros"))
    place = F.row_number().over(W.orderBy(F.desc("raw"), F.desc("tens"), "zeros", "profile"))  # of a row a profile
    return sums.withColumn("selected", place == 1)
