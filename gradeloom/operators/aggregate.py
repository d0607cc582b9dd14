"""Summaries, quantiles, group classes and transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.nearest_text import best_in_group
from ..sources.readers import scratch

SCORES = (10, 5, 1, 0)


def score_summary(score: str = "score", err: str = "rel_error", extractable: Column | None = None) -> list[Column]:
    """Aggregates of scored rows: counts, totals, a column for each score, the mean of the known errors."""
    s, e = F.col(score), F.col(err)
    return [
        F.count("*").alias("n"), F.sum(s).cast("long").alias("raw_score"), (F.lit(10) * F.count("*")).alias("max_raw_score"),
        F.round(F.sum(s) / F.count("*"), 6).alias("score_10"),
        F.count_if(F.lit(True) if extractable is None else extractable).alias("extractable"), F.count(e).alias("numeric_pairs"),
        *(F.count_if(s == k).alias(f"bucket_{k}") for k in SCORES), F.round(F.avg(e), 6).alias("rel_error_mean"),
    ]


#: The quantiles of errors.
ERROR_POINTS = {"err_p50": 0.5, "err_p90": 0.9, "err_p95": 0.95}
LENGTH_POINTS = {f"p{round(100 * p)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
#: Values of a group that one task may hold, and bins that a round of the selection counts for a group and rank.
MOST_VALUES, BINS = 1 << 20, 4096


def length_summary(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean")]


def with_quantiles(df: DataFrame, by: str, value: str, points: dict[str, float], summaries: list[Column], most: int | None = None) -> DataFrame:
    """``summaries`` and interpolated quantiles (rounded to six digits) of each group, exactly; nulls and NaN are left out of these.

    Groups of up to ``most`` values are sorted by a task each; if one is larger, all quantiles come from ``selected``.
    """
    most = MOST_VALUES if most is None else most
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    largest = df.groupBy(by).agg(F.count(known).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.groupBy(by).agg(*summaries, *(F.round(F.percentile(known, p), 6).alias(n) for n, p in points.items()))
    found = quantiles(df.select(F.col(by).alias("__b"), known.alias("__v")), "__b", "__v", points)
    return df.groupBy(by).agg(*summaries).join(found, F.col(by).eqNullSafe(F.col("__b")), "left").drop("__b")


def quantiles(df: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group by ``selected``: those of equal rank are selected once."""
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("q"), at.cast("long").alias("rank")) for n, p in points.items() for at in (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1)))))
    asked = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__g")).agg(F.count("*").alias("n")).select("__g", "n", F.explode(ranks).alias("r")).select("__g", "n", "r.*")
    got = selected(df, by, value, asked.select(F.col("__g").alias(by), "rank").distinct()).select(F.col(by).alias("__h"), F.col("rank").alias("at"), F.col("value").alias("x"))
    place = F.col("q") * (F.col("n") - 1)
    both = asked.join(got, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("rank") == F.col("at"))).groupBy("__g", "n", "name", "q").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    between = F.round(F.col("low") * (F.floor(place) + 1 - place) + F.col("high") * (place - F.floor(place)), 6)
    return both.groupBy(F.col("__g").alias(by)).agg(*(F.max(F.when(F.col("name") == n, between)).alias(n) for n in points))


def selected(df: DataFrame, by: str, value: str, asked: DataFrame) -> DataFrame:
    """(group, rank, value): the values of the ``asked`` (group, rank) in the sorted lists of all groups.

    Each rank has an interval that holds its value: first all of its group.  A round counts the values of the interval in ``BINS`` equal bins
    and goes on with the bin that has the rank, from its least to its largest value; so intervals shrink by that factor at least, and outliers
    drop out at once.  No task holds more than the bins of its groups, however many values are equal.
    """
    spark = df.sparkSession
    rows = df.select(F.col(by).alias("__g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = rows.groupBy(F.col("__g").alias("__e")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = asked.select(F.col(by).alias("group"), "rank").join(ends, F.col("group").eqNullSafe(F.col("__e"))).select("group", "rank", "low", "high", F.lit(0).cast("long").alias("below"))
    keys, done = ["group", "rank", "low", "high", "below"], None
    while True:
        path = scratch(spark, "quantiles")
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        ready = state.where("low = high").select(F.col("group").alias(by), "rank", F.col("low").alias("value"))
        done = ready if done is None else done.unionByName(ready)
        state = state.where("low < high")
        if state.isEmpty():
            return done
        inside = rows.join(state, F.col("__g").eqNullSafe(F.col("group")) & F.col("v").between(F.col("low"), F.col("high")))
        part = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: their difference is finite
        bins = inside.groupBy(*keys, F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = bins.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy("group", "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
        right = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        state = upto.where(right).select("group", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("n")).alias("below"))


def floor_quantiles(df: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per group the values at index floor(q * (n - 1)) of the sorted list.

    By counts of distinct values, so that a group of any size is only as large as its number of different values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group).orderBy(value)
    upto = F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy(group)))
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    return placed.groupBy(group).agg(F.first("n").alias("n"), *(F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(f"p{round(100 * q)}") for q in points))


def at_least(value: str, limits: tuple[float, ...], name: str = "ge") -> list[Column]:
    """Cumulative counts: how many values reach each limit."""
    return [F.count_if(F.col(value) >= t).alias(f"{name}_{str(t).replace('.', '_')}") for t in limits]


def histogram(df: DataFrame, value: str, ordinal: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties go to the one seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def duplicate_groups(df: DataFrame, key: str, response: str, number: str) -> DataFrame:
    """One row: groups of more than one row, by whether responses and numbers agree.  Keys and responses are dealt as digests."""
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    g = df.groupBy(digest(key)).agg(F.count("*").alias("n"), F.count_distinct(digest(response)).alias("responses"), F.count_distinct(number).alias("numbers")).where("n > 1")
    return g.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"),
        F.count_if(F.col("responses") <= 1).alias("exact"), F.count_if((F.col("responses") > 1) & (F.col("numbers") <= 1)).alias("consistent"), F.count_if(F.col("numbers") > 1).alias("conflicting"),
    )


def group_sizes(df: DataFrame, group: str, key: str) -> DataFrame:
    """How many groups have each number of distinct keys."""
    return df.groupBy(group).agg(F.count_distinct(key).alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def overlap_class(df: DataFrame, source: DataFrame, key: str, number: str) -> DataFrame:
    """``overlap``: whether the source has the key, and with the same number, others only, or none.

    Numbers are not gathered: rows meet the source's distinct keys, and its distinct (key, number).
    """
    keys = source.groupBy(F.col(key).alias("__k")).agg(F.count(number).alias("__numbers"))
    both = source.where(F.col(number).isNotNull()).select(F.col(key).alias("__l"), F.col(number).alias("__v")).distinct()
    joined = df.join(keys, F.col(key) == F.col("__k"), "left").join(both, (F.col(key) == F.col("__l")) & (F.col(number) == F.col("__v")), "left")
    out = F.when(F.col("__k").isNull(), "unseen").when(F.col(number).isNull() | (F.col("__numbers") == 0), "missing").when(F.col("__v").isNotNull(), "same").otherwise("conflict")
    return joined.withColumn("overlap", out).drop("__k", "__numbers", "__l", "__v")


def flag_class(same: Column, conflict: Column, missing: Column) -> Column:
    """By priority: any same, only conflicts, only missing, none."""
    return F.when(same, "has_same").when(conflict, "only_conflict").when(missing, "only_missing").otherwise("no_match")


def slices(df: DataFrame, named: dict[str, Column], measures: list[Column]) -> DataFrame:
    """Measures over named slices that may overlap, in one pass."""
    names = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in named.items())))
    return df.withColumn("slice", F.explode(names)).groupBy("slice").agg(*measures)


def transitions(df: DataFrame, kind: str, before: str, after: str) -> DataFrame:
    """Counts of each change of score, per kind and over all (kind null)."""
    return df.groupingSets([[F.col(kind), F.col(before), F.col(after)], [F.col(before), F.col(after)]], F.col(kind), F.col(before), F.col(after)).agg(F.count("*").alias("n"), F.grouping(kind).alias("over_all"))


def oracle(scores: DataFrame, run: str, key: str, score: str) -> DataFrame:
    """Per key the best score over runs (ties: the larger run name) and whether all runs agree."""
    return scores.groupBy(key).agg(F.max(F.struct(score, run)).alias("m"), F.count_distinct(score).alias("d")).select(key, F.col(f"m.{score}").alias("best"), F.col(f"m.{run}").alias("best_run"), (F.col("d") == 1).alias("all_equal"))


def oracle_summary(scores: DataFrame, run: str, key: str, score: str) -> DataFrame:
    best = oracle(scores, run, key, score)
    return best.agg(F.count("*").alias("n"), F.sum("best").alias("raw"), F.count_if(F.col("best") == 0).alias("zero_in_all"), F.count_if("all_equal").alias("all_equal"))


def hierarchical_means(df: DataFrame, kind: str, item: str, value: str) -> DataFrame:
    """Means per (kind, item) with the item's own mean and count as fallback."""
    g = df.groupingSets([[F.col(kind), F.col(item)], [F.col(item)]], F.col(kind), F.col(item)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping(kind).alias("g"))
    parent = g.where("g = 1").select(F.col(item).alias("__i"), F.col("mean").alias("item_mean"))
    return g.where("g = 0").join(parent, F.col(item) == F.col("__i"), "left").select(kind, item, "mean", "n", "item_mean")


def tail_mean(df: DataFrame, group: str, order: str, value: str, last: int = 50) -> DataFrame:
    """Mean of each group's last rows."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("__p", place).where(F.col("__p") <= last).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def advantage(df: DataFrame, value: str, group: str) -> DataFrame:
    """``advantage``: a value less the mean of its group, which is pre-aggregated and joined back."""
    means = df.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias("__mean"))
    return df.join(means, F.col(group).eqNullSafe(F.col("__g"))).withColumn("advantage", F.col(value) - F.col("__mean")).drop("__g", "__mean")


def parser_audit(df: DataFrame, simple: str, robust: str, by: list[str]) -> DataFrame:
    """Per group, how two parsers agree: both, one of them, none, and different results."""
    s, r = F.col(simple), F.col(robust)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(s).alias("simple_numeric"), F.count(r).alias("robust_numeric"), F.count_if(~s.eqNullSafe(r)).alias("mismatch"),
        F.count_if(s.isNotNull() & r.isNotNull()).alias("both"), F.count_if(s.isNotNull() & r.isNull()).alias("simple_only"), F.count_if(s.isNull() & r.isNotNull()).alias("robust_only"), F.count_if(s.isNull() & r.isNull()).alias("neither"),
    )


def evaluate_strategy(rows: DataFrame, candidates: DataFrame, row: str, candidate: str, fallback: str | None, score: Callable[[Column], Column], family: str) -> DataFrame:
    """``evaluated`` of one strategy's answers, (row, candidate)."""
    found = candidates.where(F.col(candidate).isNotNull()).select(F.col(row).alias("__r"), F.col(candidate).alias("__c"))
    return evaluated(rows.join(found, F.col(row) == F.col("__r"), "left"), "__c", fallback, score, family)


def evaluated(answers: DataFrame, candidate: str, fallback: str | None, score: Callable[[Column], Column], family: str, strategy: str | None = None) -> DataFrame:
    """Per family and over all (null), and per strategy: rows, total, uses and buckets of the answers.

    A row without a candidate takes its ``fallback`` answer, if there is one; ``score`` judges an answer.
    """
    scored = answers.withColumn("__s", score(F.coalesce(candidate, F.col(fallback)) if fallback else F.col(candidate)))
    buckets = [F.count_if(F.col("__s") == k).alias(f"b{k}") for k in SCORES]
    sets, columns = ([[strategy, family], [strategy]], [strategy, family]) if strategy else ([[family], []], [family])
    return scored.groupingSets([[F.col(c) for c in some] for some in sets], *map(F.col, columns)).agg(
        F.grouping(family).alias("over_all"), F.count("*").alias("n"), F.sum("__s").alias("raw"), F.round(F.sum("__s") / F.count("*"), 6).alias("score_10"), F.count(candidate).alias("used"), *buckets)


def by_template(df: DataFrame, template: str, answer: str, score: str, row: str, answers: int = 10, examples: int = 5) -> DataFrame:
    """Per template: rows, total, its most frequent answers (ties: seen first) and its first rows.

    Answers and examples are ranked from counts and limited before they are listed.
    """
    said = F.coalesce(F.col(answer).cast("string"), F.lit("<none>"))
    sums = df.groupBy(template).agg(F.count("*").alias("n"), F.sum(score).alias("raw"))
    counts = df.groupBy(F.col(template).alias("__t"), said.alias("a")).agg(F.count("*").alias("c"), F.min(row).alias("seen"))
    rank = F.row_number().over(W.partitionBy("__t").orderBy(F.desc("c"), "seen", "a"))
    top = counts.withColumn("p", rank).where(F.col("p") <= answers).groupBy("__t").agg(F.array_sort(F.collect_list(F.struct("p", F.concat_ws("=", "a", "c").alias("x")))).alias("l")).select("__t", F.array_join("l.x", ";").alias("top_answers"))
    first = df.select(F.col(template).alias("__u"), F.col(row).alias("r")).withColumn("p", F.row_number().over(W.partitionBy("__u").orderBy("r"))).where(F.col("p") <= examples)
    shown = first.groupBy("__u").agg(F.array_join(F.array_sort(F.collect_list("r")).cast("array<string>"), ",").alias("examples"))
    return sums.join(top, F.col(template).eqNullSafe(F.col("__t"))).join(shown, F.col(template).eqNullSafe(F.col("__u"))).select(template, "n", "raw", F.round(F.col("raw") / F.col("n"), 6).alias("score_10"), "top_answers", "examples")


def target_meta(equations: str, tokens: str) -> list[Column]:
    """Aggregates of training targets: none, one and more equations, and mean and largest number of tokens."""
    e = F.coalesce(F.col(equations), F.lit(0))
    return [F.count("*").alias("n"), F.count_if(e == 0).alias("fallback_answer_only"), F.count_if(e == 1).alias("one_equation"), F.count_if(e >= 2).alias("multi_equation"), F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 6).alias("target_tokens_mean"), F.coalesce(F.max(tokens), F.lit(0)).alias("target_tokens_max")]


def output_stats(text: Column, short: int = 40) -> list[Column]:
    """Aggregates of outputs: filled, with digits, of several lines, long, short single lines, different ones, lengths."""
    c = F.coalesce(text, F.lit(""))
    tidy = F.trim(c)
    return [
        F.count("*").alias("n"), F.count_if(tidy != "").alias("filled"), F.count_if(c.rlike("[0-9]")).alias("has_digit"), F.count_if(c.contains("\n")).alias("multiline"), F.count_if(F.length(c) > short).alias("long"),
        F.count_if(~tidy.contains("\n") & (F.length(tidy) <= short)).alias("single_short"), F.count_distinct(F.sha1(c.cast("binary"))).alias("unique_outputs"), F.round(F.avg(F.length(c)), 6).alias("mean_chars"), F.max(F.length(c)).alias("most_chars"),
    ]


def require_digits(df: DataFrame, text: str, least: float = 0.9) -> DataFrame:
    """``df``, if at least that part of its outputs holds a digit; raises otherwise."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(text), F.lit("")).rlike("[0-9]")).alias("d")).first()
    if r.n and r.d < least * r.n:
        raise ValueError(f"only {r.d} of {r.n} outputs hold a digit")
    return df


def kind_table(train: DataFrame, valid: DataFrame, kind: str, group: str, lengths: dict[str, Column]) -> DataFrame:
    """Per kind: rows of both splits, distinct groups over their union, and mean lengths."""
    both = train.withColumn("__s", F.lit(1)).unionByName(valid.withColumn("__s", F.lit(0)))
    return both.groupBy(kind).agg(F.sum("__s").alias("n_train"), F.count_if(F.col("__s") == 0).alias("n_valid"), F.count_distinct(group).alias("n_groups"), *(F.round(F.avg(c), 2).alias(n) for n, c in lengths.items()))


def coverage(df: DataFrame, kind: str, ok: Column) -> DataFrame:
    """Per kind: rows, those that are covered, and their part."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(ok).alias("covered")).withColumn("coverage", F.round(F.col("covered") / F.col("n"), 6))


def notebook_runtime(cells: DataFrame, notebook: str, tree: str) -> DataFrame:
    """Per notebook: cells with a duration and their seconds, from JSON metadata of cells.

    A cell's duration is its own, else that of ``papermill``, else of ``execution``; what is no number doesn't count.
    """
    found = [F.get_json_object(tree, f"$.{p}duration") for p in ("", "papermill.", "execution.")]
    seconds = F.coalesce(*found).try_cast("double")
    return cells.groupBy(notebook).agg(F.count(seconds).alias("n_cells"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 6).alias("total_seconds"))


def decision_sources(decisions: DataFrame, rows: DataFrame, row: str, source: str, score: str) -> DataFrame:
    """Per source of a decision: rows, total and buckets of the scored rows it decided."""
    scored = rows.select(F.col(row).alias("__r"), F.col(score).alias("__s"))
    joined = decisions.join(scored, F.col(row) == F.col("__r"))
    return joined.groupBy(F.coalesce(F.col(source), F.lit("<missing>")).alias(source)).agg(F.count("*").alias("n"), F.sum("__s").alias("raw"), *(F.count_if(F.col("__s") == k).alias(f"b{k}") for k in SCORES))


def overlap_rows(df: DataFrame, train: DataFrame, row: str, group: str, query: str, number: str, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Per row: whether its query and group occur in ``train``, the largest similarity to a query of its group, and its class.

    The sequence ratio is taken of blocks of different queries of a group, and only of pairs that can be the best.
    Another ``similarity`` of two columns is taken of all pairs in a group and reduced to its maximum.
    """
    seen = train.select(F.sha2(query, 256).alias("__q")).distinct()
    if similarity is None:
        best = best_in_group(df, train, group, query).select(F.col("group").alias("__g"), F.sha2("text", 256).alias("__t"), F.col("similarity").alias("__best"))
        on = F.col(group).eqNullSafe(F.col("__g")) & (F.sha2(query, 256) == F.col("__t"))
    else:
        groups = train.select(F.col(group).alias("__g"), F.col(query).alias("__t"))
        best = df.join(groups, F.col(group) == F.col("__g")).groupBy(F.col(row).alias("__r")).agg(F.max(similarity(F.col(query), F.col("__t"))).alias("__best"))
        on = F.col(row) == F.col("__r")
    classed = overlap_class(df, train.select(group, number), group, number)
    out = classed.join(seen, F.sha2(query, 256) == F.col("__q"), "left").join(best, on, "left")
    return out.select(row, F.col("__q").isNotNull().alias("query_seen"), (F.col("overlap") != "unseen").alias("group_seen"), F.coalesce("__best", F.lit(0.0)).alias("max_similarity"), "overlap")
