"""Gates, sweeps of thresholds, and routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import close
from ..functions.text import jaccard


def grid(**values: list[float]) -> list[dict[str, float]]:
    """The Cartesian grid of named values, in order; a configuration's number is its place."""
    return [dict(zip(values, v)) for v in product(*values.values())]


def configs_for(kinds: DataFrame, kind: str, defaults: dict[str, float], overrides: DataFrame) -> DataFrame:
    """A row a kind: each setting from the overrides of its kind, else the default."""
    o = overrides.select(F.col(kind).alias("__k"), *(F.col(c).alias(f"__{c}") for c in defaults))
    return kinds.select(kind).distinct().join(o, F.col(kind) == F.col("__k"), "left").select(kind, *(F.coalesce(F.col(f"__{c}"), F.lit(v)).alias(c) for c, v in defaults.items()))


def gate_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, else ``used``; a null check fails."""
    out = F.lit("used")
    for name, ok in reversed(checks):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def sweep(rows: DataFrame, configs: list[dict[str, float]], kind: str, passes: Callable[[dict[str, float]], Column], gated: str, base: str) -> DataFrame:
    """Per kind the configuration with the best total, and whether it beats the base.

    All configurations are conditional sums of one aggregate, so rows are neither copied nor joined.  Ties: more tens,
    fewer zeros, fewer uses, lower number.
    """
    sums = []
    for i, config in enumerate(configs):
        use = F.coalesce(passes(config), F.lit(False))
        value = F.when(use, F.col(gated)).otherwise(F.col(base))
        sums += [F.sum(value).alias(f"raw{i}"), F.count_if(value == 10).alias(f"tens{i}"), F.count_if(value == 0).alias(f"zeros{i}"), F.count_if(use).alias(f"used{i}")]
    totals = rows.groupBy(kind).agg(F.sum(base).alias("base_raw"), F.count("*").alias("n"), *sums)
    rank = lambda i: F.struct(F.col(f"raw{i}").alias("raw"), F.col(f"tens{i}").alias("tens"), (-F.col(f"zeros{i}")).alias("z"), (-F.col(f"used{i}")).alias("u"), F.lit(-i).alias("c"))
    best = totals.select(kind, "base_raw", "n", F.array_max(F.array(*(rank(i) for i in range(len(configs))))).alias("m"))
    return best.select(kind, (-F.col("m.c")).alias("config"), F.col("m.raw").alias("raw"), "base_raw", (-F.col("m.u")).alias("used"), "n", (F.col("m.raw") > F.col("base_raw")).alias("enabled"))


def grid_sweep(rows: DataFrame, axes: dict[str, list[float]], kind: str, gated: str, base: str) -> DataFrame:
    """``sweep`` over all combinations of least values of the columns of ``axes``, at a cost that their number doesn't change.

    Rows become cells, by how many limits of each axis they reach; cells are summed once; and sums from each cell on,
    along one axis after the other, give every configuration.  A null reaches no limit.  Configurations are numbered as in ``grid``.
    """
    places = [f"__i{i}" for i in range(len(axes))]
    measures = {"raw": F.col(gated) - F.col(base), "tens": (F.col(gated) == 10).cast("long") - (F.col(base) == 10).cast("long"), "zeros": (F.col(gated) == 0).cast("long") - (F.col(base) == 0).cast("long"), "used": F.lit(1)}
    reached = {p: sum((F.coalesce(F.col(c) >= t, F.lit(False)).cast("int") for t in sorted(limits)[1:]), F.coalesce(F.col(c) >= min(limits), F.lit(False)).cast("int")) for p, (c, limits) in zip(places, axes.items())}
    cells = rows.withColumns(reached).groupBy(kind, *places).agg(*(F.sum(m).alias(n) for n, m in measures.items()))
    whole = rows.groupBy(kind).agg(F.sum(base).alias("base_raw"), F.count_if(F.col(base) == 10).alias("__tens"), F.count_if(F.col(base) == 0).alias("__zeros"), F.count("*").alias("n"))
    full = whole
    for p, limits in zip(places, axes.values()):
        full = full.withColumn(p, F.explode(F.sequence(F.lit(1), F.lit(len(limits)))))
    theirs = cells.select(F.col(kind).alias("__k"), *(F.col(p).alias(f"{p}c") for p in places), *measures)
    same = F.col(kind).eqNullSafe(F.col("__k"))
    for p in places:
        same = same & (F.col(p) == F.col(f"{p}c"))
    dense = full.join(theirs, same, "left").drop("__k", *(f"{p}c" for p in places)).fillna(0, list(measures))
    for p in places:
        onwards = W.partitionBy(kind, *(q for q in places if q != p)).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
        dense = dense.withColumns({n: F.sum(n).over(onwards) for n in measures})
    number = F.lit(0)
    for p, limits in zip(places, axes.values()):
        at = F.lit(-1)
        for i, t in enumerate(limits):
            at = F.when(F.col(p) == sorted(limits).index(t) + 1, i).otherwise(at)
        number = number * len(limits) + at
    rank = F.struct((F.col("base_raw") + F.col("raw")).alias("raw"), (F.col("__tens") + F.col("tens")).alias("tens"), -(F.col("__zeros") + F.col("zeros")), (-F.col("used")).alias("u"), (-number).alias("c"))
    best = dense.groupBy(kind, "base_raw", "n").agg(F.max(rank).alias("m"))
    return best.select(kind, (-F.col("m.c")).alias("config"), F.col("m.raw").alias("raw"), "base_raw", (-F.col("m.u")).alias("used"), "n", (F.col("m.raw") > F.col("base_raw")).alias("enabled"))


def threshold_replay(rows: DataFrame, thresholds: list[float], similarity: str, gated: str, base: str) -> DataFrame:
    """Totals when values above each threshold take the place of the base: conditional sums of one aggregate."""
    use = [F.coalesce(F.col(similarity) >= t, F.lit(False)) for t in thresholds]
    totals = rows.agg(*(c for i, u in enumerate(use) for c in (F.count_if(u).alias(f"used{i}"), F.sum(F.when(u, F.col(gated)).otherwise(F.col(base))).alias(f"raw{i}"))))
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"used{i}").alias("used"), F.col(f"raw{i}").alias("raw")) for i, t in enumerate(thresholds)))
    return totals.select(F.explode(each).alias("t")).select("t.*")


def named_gates(rows: DataFrame, gates: dict[str, list[str] | None], kind: str, gated: str, base: str) -> DataFrame:
    """Totals when gated values count for the kinds that a named gate allows (None: all), the base elsewhere."""
    value = lambda kinds: F.col(gated) if kinds is None else F.when(F.col(kind).isin(*kinds), F.col(gated)).otherwise(F.col(base))
    totals = rows.agg(F.count("*").alias("n"), *(c for i, kinds in enumerate(gates.values()) for c in (F.sum(value(kinds)).alias(f"raw{i}"), F.count_if(value(kinds) == 10).alias(f"tens{i}"))))
    each = F.array(*(F.struct(F.lit(name).alias("gate"), F.col(f"raw{i}").alias("raw"), F.col(f"tens{i}").alias("tens")) for i, name in enumerate(gates)))
    return totals.select("n", F.explode(each).alias("g")).select("g.*", "n")


#: Settings of gated retrieval unless a kind has its own.
GATED = {"enabled": True, "require_typed_pool": False, "least_frac": 0.0, "least_margin": 0.0, "least_jaccard": 0.0, "agreement_bypass": False}


def gated_retrieval(queries: DataFrame, entries: DataFrame, row: str, kind: str, group: str, tokens: str, number: str, model: str, defaults: dict, by_kind: dict[str, dict], allowed: list[str] | None = None, least_rows: int = 1) -> DataFrame:
    """Per query why the answer of its group's entries is used or not: ``queries``' columns, reason, chosen, pool, frac, margin, nearest.

    The pool is the group's entries of the query's kind, or all if it has none.  Of its numbers the most frequent one is
    chosen (ties: the nearest query by Jaccard, the smaller magnitude, the larger number).  Reasons in order:
    type_gate_disabled, type_not_allowed, source_unseen, typed_pool_missing, low_confidence_model_disagree, low_confidence, used.
    Where the settings say so, a model of the same number makes up for a lack of confidence.

    Entries meet queries in one join by group; pools are aggregated by query and number, so no list of a pool is made.
    """

    def setting(name: str) -> Column:
        out = F.lit({**GATED, **defaults}[name])
        for k, own in by_kind.items():
            out = F.when(F.col(kind) == k, F.lit(own[name])).otherwise(out) if name in own else out
        return out

    asked = queries.select(F.col(row).alias("__row"), F.col(kind).alias("__kind"), F.col(group).alias("__g"), F.col(tokens).alias("__t"))
    held = entries.select(F.col(group).alias("__eg"), F.col(kind).alias("__ek"), F.col(number).cast("double").alias("__n"), F.col(tokens).alias("__et"))
    pairs = asked.join(held, F.col("__g") == F.col("__eg"))
    typed = F.col("__ek").eqNullSafe(F.col("__kind"))
    numbers = pairs.groupBy("__row", typed.alias("typed"), "__n").agg(F.count("*").alias("count"), F.max(jaccard("__t", "__et")).alias("near"))
    per_pool = numbers.groupBy("__row", "typed").agg(
        F.sum("count").alias("pool"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), (-F.col("near")).alias("j"), F.abs("__n").alias("size"), (-F.col("__n")).alias("n")))).alias("ranked"))
    pools = per_pool.groupBy("__row").agg(F.sum("pool").alias("rows"), F.max("typed").alias("typed"), F.max(F.struct("typed", "pool", "ranked")).alias("p"))
    out = queries.join(pools, F.col(row) == F.col("__row"), "left").withColumn("__rows", F.coalesce("rows", F.lit(0)))
    first, second = F.get("p.ranked", F.lit(0)), F.get("p.ranked", F.lit(1))
    pool, frac = F.col("p.pool"), -first["c"] / F.col("p.pool")
    margin, near, found = (-first["c"] + F.coalesce(second["c"], F.lit(0))) / pool, -first["j"], -first["n"]
    agrees = close(model, found)
    confident = (frac >= setting("least_frac")) & (margin >= setting("least_margin")) & (near >= setting("least_jaccard"))
    passed = F.coalesce(confident, F.lit(False)) | (setting("agreement_bypass") & agrees)
    reason = gate_reason([
        ("type_gate_disabled", setting("enabled")), ("type_not_allowed", F.lit(True) if allowed is None else F.col(kind).isin(*allowed)), ("source_unseen", F.col("__rows") >= least_rows),
        ("typed_pool_missing", ~setting("require_typed_pool") | F.col("typed")), ("low_confidence_model_disagree", passed | F.col(model).isNull() | agrees), ("low_confidence", passed),
    ])
    return out.select(*(queries[c] for c in queries.columns), reason.alias("reason"), F.when(reason == "used", found).alias("chosen"), pool.alias("pool"), frac.alias("frac"), margin.alias("margin"), near.alias("nearest"))


def strict_decisions(queries: DataFrame, hits: DataFrame, row: str, key: str, model_key: str, gate: dict[str, float], override: bool = False, fill: bool = True, ordinal: str = "ordinal") -> DataFrame:
    """Per query the model's key or, behind four limits, that of its hits: reason, source and chosen key.

    The hits' key is the one with most hits (ties: similarity, Jaccard, ``prior``, seen first).  Where it differs from the model's it is taken only if
    the model has none and ``fill`` is set, the missing-only form, or if ``override`` is.
    """
    groups = hits.groupBy(F.col(row).alias("__r"), F.col(key).alias("__k")).agg(F.count("*").alias("n"), F.max("similarity").alias("s"), F.max("jaccard").alias("j"), F.max("prior").alias("p"), F.min(ordinal).alias("o"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("s")).alias("s"), (-F.col("j")).alias("j"), (-F.col("p")).alias("p"), "o", F.col("__k").alias("k"))))
    best = groups.groupBy("__r").agg(F.sum("n").alias("hits"), ranked.alias("g"))
    out = queries.join(best, F.col(row) == F.col("__r"), "left")
    top, second = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    frac, margin = -top["n"] / F.col("hits"), (-top["n"] + F.coalesce(second["n"], F.lit(0))) / F.col("hits")
    passed = (-top["s"] >= gate["least_sim"]) & (-top["j"] >= gate["least_jaccard"]) & (frac >= gate["least_frac"]) & (margin >= gate["least_margin"])
    reason = F.when(F.col("hits").isNull(), "no_hits").when(passed, "passed").otherwise("low_confidence")
    source = F.when(reason != "passed", "model").when(top["k"] == F.col(model_key), "retrieval_model_agree").when(F.col(model_key).isNull() & F.lit(fill), "retrieval_model_missing").when(F.lit(override), "retrieval_override").otherwise("model_fallback_disagree")
    return out.select(row, reason.alias("reason"), source.alias("source"), F.when(source.startswith("retrieval"), top["k"]).otherwise(F.col(model_key)).alias("chosen"), frac.alias("frac"), margin.alias("margin"))


def ungated_majority(hits: DataFrame, queries: DataFrame, query: str, key: str, allowed: Column, least_rows: int = 1, least_frac: float = 0.34) -> DataFrame:
    """The older rule: the largest answer group of a query's hits (``jaccard``), without margins or similarity gates.

    ``allowed`` is a condition on queries.  Reasons in order: type_not_allowed, source_unseen, low_majority, used.  Ties
    of groups: the larger similarity, the smaller magnitude, the larger number, the larger key.
    """
    number = F.col(key).cast("string").try_cast("double")
    groups = hits.groupBy(F.col(query).alias("__q"), key).agg(F.count("*").alias("n"), F.max("jaccard").alias("j"))
    best = groups.groupBy("__q").agg(F.sum("n").alias("pool"), F.max(F.struct("n", "j", (-F.abs(number)).alias("size"), number.alias("number"), F.col(key).alias("key"))).alias("m"))
    out = queries.join(best, F.col(query) == F.col("__q"), "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    frac = F.col("m.n") / F.col("pool")
    reason = gate_reason([("type_not_allowed", allowed), ("source_unseen", F.col("pool") >= least_rows), ("low_majority", frac >= least_frac)])
    return out.select(*queries.columns, reason.alias("reason"), F.when(reason == "used", F.col("m.key")).alias("chosen"), "pool", frac.alias("frac"))


def split_solved(df: DataFrame, answer: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an answer, and the others."""
    return df.where(F.col(answer).isNotNull()), df.where(F.col(answer).isNull())


def select_best(summaries: DataFrame, order: list[Column]) -> DataFrame:
    """The one row that comes first."""
    return summaries.orderBy(*order).limit(1)


def typed_pool(hits: DataFrame, query: str, same_type: Column) -> DataFrame:
    """Hits of the query's own type if it has any, else all its hits."""
    h = hits.withColumn("__same", same_type)
    have = h.where("__same").select(F.col(query).alias("__q")).distinct()
    return h.join(have, F.col(query) == F.col("__q"), "left").where(F.col("__same") | F.col("__q").isNull()).drop("__same", "__q")


def route(base: DataFrame, expert: DataFrame, kind: str, key: str, score: str) -> DataFrame:
    """Per kind both totals, and whether the expert is strictly better."""
    e = expert.select(F.col(key).alias("__k"), F.col(score).alias("__s"))
    return base.join(e, F.col(key) == F.col("__k")).groupBy(kind).agg(F.sum(score).alias("base_raw"), F.sum("__s").alias("expert_raw")).withColumn("routed", F.col("expert_raw") > F.col("base_raw"))


#: Limits of a linear template: rows, relative errors, magnitude of predictions, numbers in a query.
LEAST_SUPPORT, MEAN_ERROR, LARGEST_ERROR, LARGEST_VALUE, MOST_NUMBERS = 4, 0.02, 0.10, 1e9, 6


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a block of rows: all that their least squares need, in as many rows as there are columns at most."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def linear_templates(known: DataFrame, template: str, numbers: str, answer: str) -> DataFrame:
    """Least squares of the answer on a template's numbers, for templates that it fits well.

    Each task reduces the rows of a template to a triangular factor, and factors are merged in two steps, by a few
    hundred groups and then by template, so no task meets all rows of a template.  Unlike sums of products, which square the condition number,
    that is as exact as least squares of all rows.  Errors are then checked against all rows.
    """
    kind = known.schema[template].dataType.simpleString()
    rows = known.where(F.col(answer).isNotNull() & F.col(template).isNotNull() & (F.size(numbers) <= MOST_NUMBERS)).select(template, F.concat(numbers, F.array(F.lit(1.0))).alias("x"), F.col(answer).cast("double").alias("y"))
    factors = f"template {kind}, k int, support long, factor array<double>"

    def frame(found: dict[tuple, tuple[int, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame([(t, k, n, f.reshape(-1).tolist()) for (t, k), (n, f) in found.items()], columns=["template", "k", "support", "factor"])

    def reduced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple[int, np.ndarray]] = {}
        for part in parts:
            for (t, k), some in part.groupby([part[template], part["x"].map(len)]):
                block = np.column_stack([np.array(some["x"].tolist(), float).reshape(len(some), k), some["y"]])
                n, before = found.get((t, k), (0, np.empty((0, k + 1))))
                found[t, k] = n + len(some), triangle(np.vstack([before, block]))
            if len(found) > MOST_FACTORS:
                yield frame(found)
                found = {}
        if found:
            yield frame(found)

    def merged(some: pd.DataFrame) -> pd.DataFrame:
        k = int(some["k"].iloc[0])
        return frame({(some["template"].iloc[0], k): (int(some["support"].sum()), triangle(np.vstack([np.array(f).reshape(-1, k + 1) for f in some["factor"]])))})

    def solved(some: pd.DataFrame) -> pd.DataFrame:
        done = merged(some)
        k, f = int(done["k"].iloc[0]), np.array(done["factor"].iloc[0]).reshape(-1, int(done["k"].iloc[0]) + 1)
        done["weights"] = [np.linalg.lstsq(f[:, :k], f[:, k], rcond=None)[0].tolist()]
        return done.drop(columns="factor")

    first = rows.mapInPandas(reduced, factors).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(MERGED_PARTS)))
    halfway = first.groupBy("template", "k", "part").applyInPandas(merged, factors)
    fits = halfway.groupBy("template", "k").applyInPandas(solved, f"template {kind}, k int, support long, weights array<double>")
    fits = fits.where(F.col("support") >= F.greatest(F.lit(LEAST_SUPPORT), F.col("k") + 1)).select(F.col("template").alias("__t"), F.col("k").alias("__n"), "support", "weights")
    guess = F.aggregate(F.zip_with("x", "weights", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    err = F.abs(guess - F.col("y")) / F.greatest(F.lit(1.0), F.abs("y"))
    checked = rows.join(fits, (F.col(template) == F.col("__t")) & (F.size("x") == F.col("__n"))).groupBy(template, "support", "weights").agg(F.avg(err).alias("mean_error"), F.max(err).alias("largest_error"))
    return checked.where((F.col("mean_error") <= MEAN_ERROR) & (F.col("largest_error") <= LARGEST_ERROR))


def apply_templates(queries: DataFrame, templates: DataFrame, template: str, numbers: str) -> DataFrame:
    """``predicted`` for queries of a known template; null beyond the magnitude limit."""
    t = templates.select(F.col(template).alias("__t"), "weights")
    x = F.concat(numbers, F.array(F.lit(1.0)))
    guess = F.aggregate(F.zip_with(x, "weights", lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
    return queries.join(t, (F.col(template) == F.col("__t")) & (F.size(x) == F.size("weights"))).withColumn("predicted", F.when(F.abs(guess) <= LARGEST_VALUE, guess)).drop("__t", "weights")


#: Factors that a task holds before it hands them on, and groups in which a template's factors are merged first.
MOST_FACTORS, MERGED_PARTS = 10_000, 256
