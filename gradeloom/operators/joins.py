"""Alignments, overlaps and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(gold: DataFrame, preds: DataFrame, key: str, ordinal: str | None = None, strict: bool = True) -> DataFrame:
    """Every gold row with its prediction; of repeated ids the last by ordinal counts.  ``strict``: raises if one lacks.

    Ids meet as text.  Gold columns keep their names; prediction columns come as the struct ``pred``, null if there is none.
    """
    packed = F.struct(*(F.col(c) for c in preds.columns))
    pick = F.max_by(packed, ordinal) if ordinal else F.max(packed)
    one = preds.groupBy(F.col(key).cast("string").alias("__key")).agg(pick.alias("pred"))
    out = gold.join(one, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
    if strict and (lacking := [r[0] for r in out.where("pred is null").select(key).limit(5).collect()]):
        raise ValueError(f"gold rows without a prediction, such as {lacking}")
    return out


def align_by_place(gold: DataFrame, preds: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal ordinal, predictions as the struct ``pred``; raises unless both sides have the same ordinals."""
    packed = preds.select(F.col(ordinal).alias("__place"), F.struct(*(F.col(c) for c in preds.columns)).alias("pred"))
    out = gold.join(packed, F.col(ordinal) == F.col("__place"), "full")
    if not out.where(F.col(ordinal).isNull() | F.col("__place").isNull()).isEmpty():
        raise ValueError("both sides must have the same rows")
    return out.drop("__place")


def align_as_given(gold: DataFrame, preds: DataFrame, key: str, ordinal: str) -> DataFrame:
    """By id if every row of both sides has one, else by place; raises where a gold row has no prediction."""
    lacks = lambda df: key not in df.columns or not df.where(F.col(key).isNull()).isEmpty()
    return align_by_place(gold, preds, ordinal) if lacks(gold) or lacks(preds) else align(gold, preds, key, ordinal)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both sides have."""
    return a.select(key).intersect(b.select(key))


def all_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys of any side."""
    return union_all([f.select(key) for f in frames]).distinct()


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises if a key is on both sides."""
    if shared := [r[0] for r in common_keys(a, b, key).limit(5).collect()]:
        raise ValueError(f"keys on both sides, such as {shared}")


def with_scores(candidates: DataFrame, cached: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Candidates with the cached ``score`` of their keys, null where none is cached."""
    return candidates.join(cached.select(*keys, score), keys, "left")


def integrity(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, least and largest, and whether they run without a gap."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"), F.min(key).alias("least"), F.max(key).alias("largest")).withColumn("contiguous", F.col("largest") - F.col("least") + 1 == F.col("n_distinct"))


def seen_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` has (semi-join)."""
    return df.join(other.select(key), key, "left_semi")


def seen_flags(df: DataFrame, train: DataFrame, query: str, number: str, response: str) -> DataFrame:
    """``df`` with seen_query, same_answer (a number of the query's in ``train``, but for 1e-9) and same_response.

    All keys are digests of distinct values, so a query that a third of ``train`` asks is one row a different number or response.
    Numbers meet by cells of 1e-8 and the cells beside, and are then compared.
    """
    digest = lambda *cs: F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in cs))), 256)
    cell = lambda x: F.floor(x.cast("double") * 1e8).cast("double")
    mark = lambda keys, name: keys.distinct().withColumn(name, F.lit(True))
    asked = train.where(F.col(query).isNotNull())
    queries = mark(asked.select(digest(query).alias("__q")), "__seen")
    answers = mark(asked.where(F.col(response).isNotNull()).select(digest(query, response).alias("__a")), "__same")
    numbers = asked.where(F.col(number).isNotNull()).select(digest(query).alias("__nq"), F.col(number).cast("double").alias("__v")).distinct().withColumn("__c", cell(F.col("__v")))
    rows = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__d", digest(query))
    near = rows.where(F.col(number).isNotNull()).select("__row", "__d", F.col(number).cast("double").alias("__x"), F.explode(F.transform(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), lambda i: cell(F.col(number)) + i)).alias("__near"))
    hits = near.join(numbers, (F.col("__d") == F.col("__nq")) & (F.col("__near") == F.col("__c")) & (F.abs(F.col("__x") - F.col("__v")) <= 1e-9)).select(F.col("__row").alias("__hit")).distinct()
    out = rows.join(queries, F.col("__d") == F.col("__q"), "left").join(answers, digest(query, response) == F.col("__a"), "left").join(hits, F.col("__row") == F.col("__hit"), "left")
    told = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*df.columns, told(F.col("__seen")).alias("seen_query"), F.col("__hit").isNotNull().alias("same_answer"), told(F.col("__same")).alias("same_response"))


def unseen_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` lacks, repeats included (anti-join)."""
    return df.join(other.select(key), key, "left_anti")


def unpivot_keys(df: DataFrame, row_id: str, fields: dict[str, Column], norms: dict[str, object]) -> DataFrame:
    """(row id, field, norm, SHA-1 of the key) of every field under every norm, without empty keys."""
    parts = [F.struct(F.lit(f).alias("field"), F.lit(n).alias("norm"), norm(c).alias("key")) for f, c in fields.items() for n, norm in norms.items()]
    return df.select(row_id, F.explode(F.array(*parts)).alias("k")).where("k.key is not null and k.key != ''").select(row_id, "k.field", "k.norm", F.sha1(F.col("k.key").cast("binary")).alias("key"))


def overlap_matrix(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each norm and pair of fields of two ``unpivot_keys``: rows of ``right`` with a partner, and pairs.

    Pairs are counted from per-key counts; they are never formed.
    """
    a = left.groupBy("norm", F.col("field").alias("left_field"), "key").agg(F.count("*").alias("n"))
    b = right.groupBy("norm", F.col("field").alias("right_field"), "key").agg(F.count("*").alias("m"), F.count_distinct(right_id).alias("rows"))
    return a.join(b, ["norm", "key"]).groupBy("norm", "left_field", "right_field").agg(F.sum("rows").alias("n_rows"), F.sum(F.col("n") * F.col("m")).alias("n_pairs"))


def overlay(base: DataFrame, over: DataFrame, key: str, value: str, routed: Column | None = None) -> DataFrame:
    """``value`` of ``over`` where it has the key (and the row is routed), else of ``base``; ``origin`` tells which."""
    o = over.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    hit = F.col("__k").isNotNull() & (F.lit(True) if routed is None else routed)
    out = base.join(o, F.col(key) == F.col("__k"), "left")
    return out.withColumn("origin", F.when(hit, "over").otherwise("base")).withColumn(value, F.when(hit, F.col("__v")).otherwise(F.col(value))).drop("__k", "__v")


def coalesce_sources(keys: DataFrame, sources: list[DataFrame], key: str, value: str, required: bool = False) -> DataFrame:
    """For each key the value of the first source that has it; ``required``: raises if none has."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"__v{i}")), key, "left")
    out = out.select(*keys.columns, F.coalesce(*(F.col(f"__v{i}") for i in range(len(sources)))).alias(value))
    if required and not out.where(F.col(value).isNull()).isEmpty():
        raise ValueError("keys that no source has")
    return out


def pair_runs(scores: DataFrame, run: str, key: str, score: str) -> DataFrame:
    """For each pair of runs: common rows, better, worse, same, and the difference of the scores.

    One row a key with its runs in order, which makes the pairs: one shuffle, as many scores a key as there are runs.
    """
    runs = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(score).alias("s")))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.filter("l", lambda y, j: j > i), lambda y: F.struct(x["r"].alias("run_a"), y["r"].alias("run_b"), x["s"].alias("a"), y["s"].alias("b")))))
    rows = runs.select(F.explode(pairs).alias("p")).select("p.*").where("run_a < run_b and a is not null and b is not null")
    return rows.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.count_if(F.col("b") > F.col("a")).alias("better"), F.count_if(F.col("b") < F.col("a")).alias("worse"), F.count_if(F.col("b") == F.col("a")).alias("same"), F.sum(F.col("b") - F.col("a")).alias("delta"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def missing_keys(gold: DataFrame, preds: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The first ``most`` keys of ``gold`` without a prediction."""
    return unseen_in(gold.select(key), preds, key).orderBy(key).limit(most)
