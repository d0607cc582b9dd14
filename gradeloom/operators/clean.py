"""Cleaning, dedup, splits and samples.

Every choice depends on values and an ordinal alone, so results do not change with partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, stable_fraction


def digest(keys: list[str]) -> Column:
    """A key of bounded size for long keys: SHA-1 of their texts, nulls told apart."""
    return F.sha1(F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))), {"ignoreNullFields": "false"}).cast("binary"))


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by ordinal; a partial aggregate of ordinals, then a join back of survivors.

    No window: a key that holds a third of all rows is pre-aggregated instead of being sorted in one task.  Keys meet
    by digest, so that long texts are not shuffled as keys.
    """
    first = df.groupBy(digest(keys).alias("__key")).agg(F.min(ordinal).alias("__first"))
    marked = df.withColumn("__digest", digest(keys))
    return marked.join(first, (F.col("__digest") == F.col("__key")) & (F.col(ordinal) == F.col("__first")), "left_semi").drop("__digest")


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reject_reason``: the name of the first rule that holds, null for rows to keep."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return df.withColumn("reject_reason", out)


def clean_records(df: DataFrame, query: str, response: str | None, ordinal: str, numeric: Column | None = None) -> DataFrame:
    """Trims, drops rows without query (or response), exact repeats but the first, and rows without a number."""
    names = [query] + ([response] if response else [])
    out = df.select(*(F.trim(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))
    out = reject_reasons(out, [(f"empty_{c}", F.coalesce(F.col(c), F.lit("")) == "") for c in names]).where("reject_reason is null").drop("reject_reason")
    out = keep_first(out, names, ordinal)
    return out if numeric is None else out.where(numeric.isNotNull())


def salted(key: Column | str, salt: str) -> Column:
    return stable_fraction(F.concat(F.lit(salt), (F.col(key) if isinstance(key, str) else key).cast("string")))


def hash_split(df: DataFrame, key: str, fraction: float, salt: str = "split:") -> DataFrame:
    """``held``: whether the key's hash falls below ``fraction``; rows of one key stay together."""
    return df.withColumn("held", salted(key, salt) < fraction)


#: Parts of the range of hashes by which a large group is cut.
HASH_PARTS = 1024


def least_hashes(keys: DataFrame, take: Callable[[Column], Column]) -> DataFrame:
    """``held``: of the distinct keys (__g, __k, __f) those of least hash __f in their group, ``take`` of a group's size.

    Counts by part of the range of hashes tell in which part the last of them lies; only that part's keys are ranked, so
    no task sorts a whole group.
    """
    parted = keys.withColumn("__part", F.floor(F.col("__f") * HASH_PARTS).cast("int"))
    size, upto = F.sum("__n").over(W.partitionBy("__g")), F.sum("__n").over(W.partitionBy("__g").orderBy("__part"))
    parts = parted.groupBy("__g", "__part").agg(F.count("*").alias("__n")).select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), (take(size) - (upto - F.col("__n"))).alias("__left"), "__n")
    joined = parted.join(parts, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")))
    split = joined.where((F.col("__left") > 0) & (F.col("__left") < F.col("__n")))
    ranked = split.withColumn("__held", F.row_number().over(W.partitionBy("__g", "__part").orderBy("__f", "__k")) <= F.col("__left"))
    whole = joined.where((F.col("__left") <= 0) | (F.col("__left") >= F.col("__n"))).withColumn("__held", F.col("__left") > 0)
    return ranked.unionByName(whole).select("__g", "__k", F.col("__held").alias("held"))


def holdout_per_group(df: DataFrame, group: str, key: str, fraction: float = 0.1, salt: str = "holdout:") -> DataFrame:
    """``held``: in each group of two keys or more, about ``fraction`` of its distinct keys, one at least, not all."""
    keys = df.select(F.col(group).alias("__g"), F.col(key).alias("__k"), salted(F.col(key), salt).alias("__f")).distinct()
    chosen = least_hashes(keys, lambda size: F.when(size >= 2, F.greatest(F.lit(1), F.least(size - 1, F.bround(size * fraction).cast("long")))).otherwise(0))
    return df.join(chosen, F.col(group).eqNullSafe(F.col("__g")) & F.col(key).eqNullSafe(F.col("__k"))).drop("__g", "__k")


def group_disjoint_split(df: DataFrame, group: str, kind: str, fraction: float = 0.1, salt: str = "group:") -> DataFrame:
    """``held``: whole groups, about ``fraction`` of those of each dominant kind, one at least."""
    counts = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    main = counts.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(kind))).alias("m"))
    keys = main.select(F.col(f"m.{kind}").alias("__g"), F.col(group).alias("__k"), salted(F.col(group), salt).alias("__f"))
    chosen = least_hashes(keys, lambda size: F.greatest(F.lit(1), F.bround(size * fraction).cast("long"))).drop("__g")
    return df.join(chosen, F.col(group).eqNullSafe(F.col("__k"))).drop("__k")


def calibration_split(df: DataFrame, key: str, fraction: float, cap: int | None = None) -> DataFrame:
    """The calibration rows, the first ``cap`` of them by a salted hash."""
    held = df.where(salted(key, "") < fraction)
    return held if cap is None else held.orderBy(salted(key, "calib:"), key).limit(cap)


def balanced_subset(df: DataFrame, kind: str, key: str, size: int, salt: str = "balanced:") -> DataFrame:
    """Round-robin over sorted kinds: the first of each, then the second, until ``size``."""
    turn = F.row_number().over(W.partitionBy(kind).orderBy(salted(key, salt), key))
    return df.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", kind).limit(size)


def sample(df: DataFrame, key: str, size: int, salt: str = "sample:") -> DataFrame:
    return df.orderBy(salted(key, salt), key).limit(size)


def replay(df: DataFrame, key: str, fraction: float, salt: str = "replay:") -> DataFrame:
    """``df`` and, once more, the rows whose hash falls below ``fraction``; ``is_replay`` tells them apart."""
    return df.withColumn("is_replay", F.lit(False)).unionByName(df.where(salted(key, salt) < fraction).withColumn("is_replay", F.lit(True)))


def distilled_records(records: DataFrame, taught: DataFrame, key: str, canonical: Column, reasoning: str, target: Callable[[Column], Column], replayed: float) -> DataFrame:
    """Records with a canonical answer and the reasoning that ``taught`` (a row a key) has for them, before the answer's
    target line; without one the target alone.  Rows whose hash falls below ``replayed`` come once more with the target alone.
    """
    answer = records.withColumn("__line", target(canonical)).where(canonical.isNotNull())
    known = taught.select(F.col(key).alias("__k"), F.col(reasoning).alias("__r"))
    joined = answer.join(known, F.col(key) == F.col("__k"), "left").withColumn("has_reasoning", F.col("__r").isNotNull())
    first = joined.withColumns({"target": F.coalesce(F.concat("__r", F.lit("\n"), "__line"), F.col("__line")), "stage": F.lit("taught_or_fallback")})
    again = joined.where(stable_fraction(key) < replayed).withColumns({"target": F.col("__line"), "stage": F.lit("replay")})
    return first.unionByName(again).drop("__k", "__r", "__line")


def augment(df: DataFrame, weight: str, order: str, most_copies: int, cap: int) -> DataFrame:
    """min(most_copies, weight // 2) numbered copies of each row; the first ``cap`` of all by ``order`` and number."""
    copies = F.least(F.lit(most_copies), F.floor(F.col(weight) / 2).cast("int"))
    some = df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return some.orderBy(order, "copy").limit(cap)


def _ahead(sums: DataFrame, width: int, levels: int) -> DataFrame:
    """(b, ahead) of bucket sums (b, s): what lies before each bucket, by buckets of buckets."""
    if levels == 0:
        return sums.select("b", (F.sum("s").over(W.orderBy("b")) - F.col("s")).alias("ahead"))
    up = F.floor(F.col("b") / width)
    above = _ahead(sums.groupBy(up.alias("b")).agg(F.sum("s").alias("s")), width, levels - 1).select(F.col("b").alias("up"), F.col("ahead").alias("base"))
    inside = sums.select("b", "s", up.alias("u")).withColumn("inside", F.sum("s").over(W.partitionBy("u").orderBy("b")) - F.col("s"))
    return inside.join(above, F.col("u") == F.col("up")).select("b", (F.col("base") + F.col("inside")).alias("ahead"))


def running_total(df: DataFrame, value: str, order: str, width: int, levels: int = 2) -> DataFrame:
    """``total`` of ``value`` up to each row by a numeric ``order``: per bucket of ``width``, then inside it.

    Buckets are summed up in buckets of buckets, ``levels`` times, so the one window without a partition runs over the
    range of ``order`` divided by ``width`` to the power of ``levels + 1``.
    """
    b = F.floor(F.col(order) / width)
    ahead = _ahead(df.groupBy(b.alias("b")).agg(F.sum(value).alias("s")), width, levels).select(F.col("b").alias("__b"), F.col("ahead").alias("__ahead"))
    inside = F.sum(value).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.join(ahead, b == F.col("__b")).withColumn("total", F.col("__ahead") + inside).drop("__b", "__ahead")


def with_target(df: DataFrame, canonical: Column, target: Column, stage: str) -> DataFrame:
    """Rows with a canonical answer, their ``target`` text and ``stage``: answer-only and stage records."""
    return df.where(canonical.isNotNull()).withColumn("target", target).withColumn("stage", F.lit(stage))


def mode_mix(df: DataFrame, key: str, stage: str, compact: Column, answer_only: Column, fraction: float) -> DataFrame:
    """``target_mode`` and ``target``: compact for keys whose salted hash falls below ``fraction``, else the answer alone."""
    is_compact = stable_fraction(F.concat(F.lit(f"{stage}:"), F.col(key).cast("string"))) < fraction
    return df.withColumn("target_mode", F.when(is_compact, "compact_equation").otherwise("answer_only")).withColumn("target", F.when(is_compact, compact).otherwise(answer_only))


def of_kinds(df: DataFrame, kind: str, kinds: list[str], row_id: str, ordinal: str) -> DataFrame:
    """Rows of some kinds (null: ``unknown``) with their ids, or positions where there is none, and their positions."""
    return df.where(F.coalesce(F.col(kind), F.lit("unknown")).isin(*kinds)).withColumn(row_id, F.coalesce(F.col(row_id), F.col(ordinal))).withColumn("position", F.col(ordinal))


def source_entries(df: DataFrame, name: str, ordinal: str, query: str, key: str) -> DataFrame:
    """Index entries of rows with a query and an answer key: source, position, query, key."""
    some = (F.coalesce(F.col(query), F.lit("")) != "") & F.col(key).isNotNull()
    return df.where(some).select(F.lit(name).alias("source"), F.col(ordinal).alias("position"), F.col(query).alias("query"), F.col(key).alias("key"))


def gold_from_report(report: DataFrame) -> DataFrame:
    """Gold rows made of a report's rows: id, type and the answer behind an anchor (null answers as ``None``)."""
    return report.select("id", "type", F.concat(F.lit("#### "), F.coalesce(F.col("gold_answer").cast("string"), F.lit("None"))).alias("response"))


def cyclic_batch(df: DataFrame, ordinal: str, n: int, step: int, size: int) -> DataFrame:
    """The ``size`` of ``n`` rows (numbered from 0) that come at a step, beginning again after the last one, with ``turn``."""
    turn = F.pmod(F.col(ordinal) - F.lit(step * size), F.lit(n))
    return df.withColumn("turn", turn).where(F.col("turn") < size)
