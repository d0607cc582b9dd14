"""Priors, majorities, consensus, candidates and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def priors(df: DataFrame, answer: str, kind: str | None = None) -> DataFrame:
    """Counts of answers, over all and, with ``kind``, per kind as well; norm = log1p(n) / log1p(largest n)."""
    sets = [[F.col(answer)]] if kind is None else [[F.col(answer)], [F.col(kind), F.col(answer)]]
    cols = [F.col(answer)] if kind is None else [F.col(kind), F.col(answer)]
    counts = df.where(F.col(answer).isNotNull()).groupingSets(sets, *cols).agg(F.count("*").alias("n"), (F.lit(0) if kind is None else F.grouping(kind)).alias("over_all"))
    scope = ["over_all"] if kind is None else ["over_all", kind]
    top = counts.groupBy(*scope).agg(F.max("n").alias("top"))
    cond = F.col("c.over_all") == F.col("t.over_all")
    if kind is not None:
        cond = cond & F.col(f"c.{kind}").eqNullSafe(F.col(f"t.{kind}"))
    return counts.alias("c").join(top.alias("t"), cond).select("c.*", (F.log1p("c.n") / F.log1p("t.top")).alias("prior_norm"))


def majority(df: DataFrame, query: str, answer: str, ordinal: str) -> DataFrame:
    """Per query its most frequent answer (ties: seen first), its part, and its lead over the second."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(query, answer).agg(F.count("*").alias("n"), F.min(ordinal).alias("seen"))
    best = counts.groupBy(query).agg(F.min(F.struct(-F.col("n"), "seen", answer)).alias("b"), F.sum("n").alias("votes"), F.count("*").alias("n_unique"))
    second = counts.join(best.select(F.col(query).alias("__q"), F.col(f"b.{answer}").alias("__a")), (F.col(query) == F.col("__q")) & (F.col(answer) != F.col("__a"))).groupBy("__q").agg(F.max("n").alias("second"))
    top = -F.col("b.col1")
    return best.join(second, F.col(query) == F.col("__q"), "left").select(query, F.col(f"b.{answer}").alias("top_answer"), "votes", "n_unique", top.alias("top_n"), (top / F.col("votes")).alias("frac"), ((top - F.coalesce("second", F.lit(0))) / F.col("votes")).alias("margin"))


def gated_majority(found: DataFrame, least_frac: float = 0.6, base: float = 1.0) -> DataFrame:
    """Majorities of a large enough part, with a confidence that follows it."""
    return found.where(F.col("frac") >= least_frac).withColumn("confidence", F.least(F.lit(1.0), base * F.col("frac")))


def consensus(votes: DataFrame, query: str, key: str, priority: str, prior: str | None = None) -> DataFrame:
    """Per query the key with most votes; ties: prior, best priority, smaller magnitude, larger key."""
    g = votes.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.count("*").alias("votes"), F.max(priority).alias("priority"), F.max(F.col(prior) if prior else F.lit(0.0)).alias("prior"))
    size = -F.abs(F.col(key).cast("string").try_cast("double"))
    return g.groupBy(query).agg(F.max(F.struct("votes", "prior", "priority", F.coalesce(size, F.lit(float("-inf"))).alias("size"), key)).alias("m")).select(query, F.col(f"m.{key}").alias("chosen"), F.col("m.votes").alias("votes"), F.col("m.priority").alias("priority"))


def first_of_mode(df: DataFrame, query: str, value: str, text: str, ordinal: str, digits: int = 6) -> DataFrame:
    """Per query the first text whose rounded value is the most frequent; without any value the first text."""
    rows = df.withColumn("__v", F.bround(value, digits))
    g = rows.groupBy(query, "__v").agg(F.count("*").alias("n"), F.min(F.struct(ordinal, text)).alias("f"))
    rank = F.struct(F.when(F.col("__v").isNull(), 0).otherwise(-F.col("n")), F.col(f"f.{ordinal}"), F.col(f"f.{text}").alias("t"))
    return g.groupBy(query).agg(F.min(rank).alias("m")).select(query, F.col("m.t").alias("chosen"))


def answer_groups(hits: DataFrame, query: str, key: str) -> DataFrame:
    """Retrieval hits (similarity, jaccard) as one row a query and answer, ranked, with part and lead of the first."""
    g = hits.groupBy(query, key).agg(F.count("*").alias("retrieval_count"), F.max("similarity").alias("top_sim"), F.max("jaccard").alias("top_jaccard"))
    w = W.partitionBy(query)
    order = w.orderBy(F.desc("retrieval_count"), F.desc("top_sim"), F.desc("top_jaccard"), key)
    total = F.sum("retrieval_count").over(w)
    rank, lead = F.row_number().over(order), F.col("retrieval_count") - F.coalesce(F.lead("retrieval_count").over(order), F.lit(0))
    return g.select("*", rank.alias("rank"), (F.col("retrieval_count") / total).alias("frac"), F.when(rank == 1, lead / total).otherwise(0.0).alias("margin"))


def group_confidence(same_numbers: Column, same_skeleton: Column) -> Column:
    """Confidence of an answer group (columns as from ``answer_groups``)."""
    raw = 0.50 * F.col("top_sim") + 0.18 * F.col("top_jaccard") + 0.18 * F.col("frac") + 0.10 * F.col("margin")
    return F.least(F.lit(1.0), raw + F.when(same_numbers, 0.12).otherwise(0.0) + F.when(same_skeleton, 0.08).otherwise(0.0))


def direct_safe(same_numbers: Column, same_skeleton: Column) -> Column:
    return (F.col("top_sim") >= 0.92) & (F.col("top_jaccard") >= 0.70) & (F.col("frac") >= 0.55) & (F.col("margin") >= 0.20) & (same_numbers | same_skeleton)


def retrieval_candidates(hits: DataFrame, row: str, key: str, most: int, ordinal: str) -> DataFrame:
    """Per row its ``most`` largest answer groups as candidates: key, source, confidence and facts (similarities, part, lead, shared numbers, skeletons).

    Hits have similarity, jaccard, same_numbers and same_skeleton (booleans).  A group is directly safe if its similarities, part
    and lead pass their limits and a hit shares numbers or skeleton; its confidence is 0.94 at least.
    """
    counts = {"retrieval_count": F.count("*"), "same_numbers": F.count_if("same_numbers"), "same_skeleton": F.count_if("same_skeleton"), "top_sim": F.max("similarity"), "top_jaccard": F.max("jaccard"), "__o": F.min(ordinal)}
    groups = hits.where(F.col(key).isNotNull()).groupBy(row, key).agg(*(c.alias(n) for n, c in counts.items()))
    totals = hits.groupBy(F.col(row).alias("__r")).agg(F.count("*").alias("hits"))
    order = W.partitionBy(row).orderBy(*(F.desc(c) for c in list(counts)[:5]), "__o", key)
    rank, lead = F.row_number().over(order), F.col("retrieval_count") - F.coalesce(F.lead("retrieval_count").over(order), F.lit(0))
    placed = groups.join(totals, F.col(row) == F.col("__r")).withColumns({"rank": rank, "frac": F.col("retrieval_count") / F.col("hits"), "margin": F.when(rank == 1, lead / F.col("hits")).otherwise(0.0)})
    numbers, skeleton = F.col("same_numbers") > 0, F.col("same_skeleton") > 0
    safe = direct_safe(numbers, skeleton)
    conf = group_confidence(numbers, skeleton)
    facts = F.struct("top_sim", "top_jaccard", "frac", "margin", "same_numbers", "same_skeleton")
    return placed.where(F.col("rank") <= most).select(row, key, F.when(safe, DIRECT).otherwise("retrieval_group").alias("source"), F.when(safe, F.greatest(conf, F.lit(PROFILE["direct_confidence"]))).otherwise(conf).alias("confidence"), "rank", facts.alias("facts"))


def merge_candidates(frames: list[DataFrame], row: str, key: str) -> DataFrame:
    """The union of candidate tables (row, key, source, confidence), one row a key: largest confidence, all sources."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(F.col(key).isNotNull()).groupBy(row, key).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))


def model_and_retrieval(model: DataFrame, groups: DataFrame, row: str, key: str) -> DataFrame:
    """Full merge of model votes and answer groups; what a side lacks is 0."""
    zero = [c for c in [*model.columns, *groups.columns] if c not in (row, key)]
    return model.join(groups, [row, key], "full").na.fill(0, zero)


def pick(cands: DataFrame, row: str, key: str, score: Column, ties: list[Column]) -> DataFrame:
    """Per row the candidate of the largest (score, ties..., key)."""
    parts = [score.alias("s"), *(t.alias(f"t{i}") for i, t in enumerate(ties)), F.col(key).alias("k")]
    return cands.groupBy(row).agg(F.max(F.struct(*parts)).alias("m")).select(row, F.col("m.k").alias("chosen"), F.col("m.s").alias("score"))


def select_candidates(cands: DataFrame, row: str, key: str, profile: dict[str, float]) -> DataFrame:
    """Per row the candidate of the largest (score, has a model, retrieval passes, votes, prior, key), as from ``model_and_retrieval``.

    A candidate of retrieval alone counts only where the profile has ``retrieval_only`` and its four limits are passed.
    """
    p = {"vote": 1.0, "prior": 0.0, "bonus": 0.0, "retrieval_only": False, "least_sim": 1.0, "least_jaccard": 1.0, "least_frac": 1.0, "least_margin": 1.0, **profile}
    passes = (F.col("top_sim") >= p["least_sim"]) & (F.col("top_jaccard") >= p["least_jaccard"]) & (F.col("frac") >= p["least_frac"]) & (F.col("margin") >= p["least_margin"])
    model = F.col("model_votes") > 0
    score = p["vote"] * F.col("model_frac") + p["prior"] * F.col("prior_norm") + 0.001 * F.col("model_priority") + F.when(passes, p["bonus"] + 0.20 * F.col("frac") + 0.10 * F.col("margin")).otherwise(0.0)
    some = cands.where(model | (F.lit(p["retrieval_only"]) & passes))
    return pick(some, row, key, F.round(score, 9), [model, passes, F.col("model_votes"), F.col("prior")])


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes by rank before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def linear_rank_score(profile: dict[str, float]) -> Column:
    """Score of model-and-retrieval candidates by a profile's weights; candidates without a likelihood count as -100."""
    gate = (F.col("top_sim") >= profile.get("least_sim", 0.70)) & (F.col("top_jaccard") >= profile.get("least_jaccard", 0.45)) & (F.col("retrieval_count") > 0)
    base = profile.get("ll", 0.0) * F.coalesce(F.col("mean_logprob"), F.lit(-100.0)) if "ll" in profile else F.lit(0.0)
    return base + profile.get("vote", 0.0) * F.col("model_frac") + profile.get("prior", 0.0) * F.col("prior_norm") - profile.get("sanity", 0.0) * F.col("sanity_penalty") + F.when(gate, profile.get("bonus", 0.0)).otherwise(0.0) + F.when(gate & (F.col("model_votes") > 0), profile.get("agree", 0.0)).otherwise(0.0)


def sanity_penalty(query: Column, value: Column, rules: list[tuple[list[str], list[tuple[float, float]]]], large: tuple[tuple[float, float], ...] = ((1e6, 3.0), (1e5, 1.0))) -> Column:
    """Penalties by magnitude, and by magnitude for queries that hold one of some phrases (the first limit passed)."""
    size = F.abs(value)
    out = F.lit(0.0)
    for limit, cost in large:
        out = out + F.when(size > limit, cost).otherwise(0.0)
    for phrases, limits in rules:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | query.contains(phrase)
        cost = F.lit(0.0)
        for limit, c in sorted(limits):
            cost = F.when(size > limit, c).otherwise(cost)
        out = out + F.when(hit, cost).otherwise(0.0)
    return F.when(value.isNull(), 3.0).otherwise(out)


def nearest_group(hits: DataFrame, groups: DataFrame, query: str, key: str, similarity: str, ordinal: str) -> DataFrame:
    """Per query the answer group of its nearest hit (ties: the first by ordinal), with that hit's similarity."""
    best = hits.groupBy(F.col(query).alias("__q")).agg(F.max(F.struct(F.col(similarity).alias("s"), (-F.col(ordinal)).alias("o"), F.col(key).alias("k"))).alias("m"))
    joined = groups.join(best, (F.col(query) == F.col("__q")) & (F.col(key) == F.col("m.k")))
    return joined.select(*groups.columns, F.col("m.s").alias("nearest"))


#: Sources that are safe by themselves, and the default profile of the verified override.
SAFE_SOURCES = ("template_exact_query", "template_exact_numbers", "template_linear")
DIRECT = "retrieval_direct_safe"
PROFILE = {
    "least_sim": 0.92, "least_jaccard": 0.70, "least_frac": 0.55, "least_margin": 0.20, "direct_confidence": 0.94,
    "safe_confidence": 0.90, "least_confidence": 0.82, "tolerance": 0.35, "override_margin": 0.55,
}


def profile_safe(retrieved: str, profile: dict[str, float]) -> Column:
    """Whether any retrieval facts (array of structs) of a candidate pass all limits and share numbers or skeleton."""
    limit = {**PROFILE, **profile}
    ok = lambda m: (m["top_sim"] >= limit["least_sim"]) & (m["top_jaccard"] >= limit["least_jaccard"]) & (m["frac"] >= limit["least_frac"]) & (m["margin"] >= limit["least_margin"]) & ((m["same_numbers"] > 0) | (m["same_skeleton"] > 0))
    return F.coalesce(F.exists(retrieved, ok), F.lit(False))


def verified_override(cands: DataFrame, row: str, key: str, model_key: str, profile: dict[str, float] | None = None, retrieved: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """``verified_overrides`` of one profile: chosen key and reason per row."""
    return verified_overrides(cands, row, key, model_key, {"": profile or {}}, retrieved, ordinal).drop("profile")


def verified_overrides(cands: DataFrame, row: str, key: str, model_key: str, profiles: dict[str, dict[str, float]], retrieved: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Per profile and row the model's candidate, unless another one is safe or much likelier: chosen key and reason.

    Candidates have ``sources`` (array), ``confidence``, ``prior_norm``, ``logprob`` and an ordinal; without a candidate
    of the model's key the first one stands for it.  Another candidate may take its place if the model has no answer, if
    its source is safe, confident and not much less likely, or if it is confident and likelier by a margin; of these the
    one of the largest rank, to nine digits; ties: the first.  ``retrieved`` names an array of retrieval facts, which a profile judges;
    without it the source of directly safe retrieval counts as safe.

    The candidates are read and dealt by row once, whatever the number of profiles: each is an aggregate of the same groups.
    """
    rank = F.struct((F.col(key).eqNullSafe(F.col(model_key)) & F.col(model_key).isNotNull()).alias("own"), (-F.col(ordinal)).alias("o"), F.col("logprob").alias("lp"), F.col(key).alias("k"))
    both = cands.withColumn("m", F.max(rank).over(W.partitionBy(row)))
    facts = both.withColumns({"delta": F.coalesce(F.col("logprob") - F.col("m.lp"), F.lit(0.0)), "own": -F.col(ordinal) == F.col("m.o")})

    def pick(profile: dict[str, float]) -> Column:
        p = {**PROFILE, **profile}
        direct = profile_safe(retrieved, p) if retrieved else F.array_contains("sources", DIRECT)
        safe = F.arrays_overlap("sources", F.array(*map(F.lit, SAFE_SOURCES))) | direct
        conf = F.when(direct, F.greatest(F.col("confidence"), F.lit(p["direct_confidence"]))).otherwise(F.col("confidence")) if retrieved else F.col("confidence")
        missing = F.col(model_key).isNull() & F.col(key).isNotNull() if p.get("allow_missing", True) else F.lit(False)
        by_safety = safe & (conf >= p["safe_confidence"]) & (F.col("delta") >= -p["tolerance"])
        by_likelihood = (conf >= p["least_confidence"]) & (F.col("delta") >= p["override_margin"])
        score = 2.0 * conf + 0.30 * F.col("prior_norm") + 0.75 * F.col("delta") + F.when(safe, 0.35).otherwise(0.0)
        reason = F.when(missing, "model_missing").when(by_safety, "safe_template_or_retrieval").otherwise("logprob_override")
        eligible = ~F.col("own") & (missing | by_safety | by_likelihood)
        return F.max(F.when(eligible, F.struct(F.round(score, 9).alias("s"), (-F.col(ordinal)).alias("o"), F.col(key).alias("k"), reason.alias("r"))))

    best = facts.groupBy(row).agg(F.first("m.k").alias("m"), *(pick(p).alias(f"b{i}") for i, p in enumerate(profiles.values())))
    chosen = lambda b: F.when(b.isNull(), F.col("m")).otherwise(b["k"])
    each = F.array(*(F.struct(F.lit(name).alias("profile"), chosen(F.col(f"b{i}")).alias("chosen"), F.coalesce(F.col(f"b{i}.r"), F.lit("model_default")).alias("reason")) for i, name in enumerate(profiles)))
    return best.select(row, F.explode(each).alias("e")).select("e.profile", row, "e.chosen", "e.reason")


def model_first(cands: DataFrame, row: str, is_model: Column, order: list[Column], most: int = 6) -> DataFrame:
    """The model's candidates, then the best others, ``most`` a row in all."""
    return top_k(cands.withColumn("__model", F.coalesce(is_model, F.lit(False))), row, [F.desc("__model"), *order], most).drop("__model")


def first_of_each(df: DataFrame, row: str, named: dict[str, Column], ordinal: str) -> DataFrame:
    """For each named condition that any row meets, the first of these rows: one aggregate."""
    found = df.agg(*(F.min_by(F.when(cond, F.col(row)), F.when(cond, F.col(ordinal))).alias(f"x{i}") for i, cond in enumerate(named.values())))
    each = F.array(*(F.struct(F.lit(name).alias("error"), F.col(f"x{i}").alias("id")) for i, name in enumerate(named)))
    return found.select(F.explode(each).alias("e")).select("e.*").where("id is not null")


def ordered_checkpoints(df: DataFrame, path: str, epoch: str, final: str, name: str, latest: int | None = None) -> DataFrame:
    """Distinct checkpoints by (epoch, final, name), a null epoch last, numbered; the ``latest`` of them alone if asked."""
    key = F.struct(F.coalesce(F.col(epoch).cast("double"), F.lit(1e9)).alias("epoch"), F.coalesce(F.col(final), F.lit(False)).cast("int").alias("final"), F.col(name).alias("name"))
    one = df.groupBy(path).agg(F.min(key).alias("k")).select(path, "k.*")
    if latest is not None:
        one = one.orderBy(F.desc("epoch"), F.desc("final"), F.desc("name")).limit(latest)
    return one.orderBy("epoch", "final", "name")


def unique_entries(df: DataFrame, label: str, key: list[Column], order: str, ordinal: str, k: int | None = None) -> DataFrame:
    """Entries of epochs, the first of each label, the best ``k`` by ``key``, in their own order."""
    epochs = df.where(F.col(label).startswith("epoch_"))
    first = epochs.groupBy(F.col(label).alias("__l")).agg(F.min(ordinal).alias("__o"))
    one = epochs.join(first, (F.col(label) == F.col("__l")) & (F.col(ordinal) == F.col("__o"))).drop("__l", "__o")
    return (one if k is None else one.orderBy(*key).limit(k)).orderBy(F.asc_nulls_last(order), label)


def checkpoint_curve(reports: DataFrame, run: str, selected: str, checkpoints: str) -> DataFrame:
    """A row a checkpoint of each run's report (array of structs with ``label``), and whether it is the selected one."""
    each = reports.select(run, selected, F.explode(checkpoints).alias("c"))
    return each.select(run, "c.*", F.col("c.label").eqNullSafe(F.col(selected)).alias("selected"))


#: Phrases and limits of the sanity penalty, each limit with its cost; the largest limit passed counts.
COUNTED = (
    "bao nhiêu sản phẩm", "bao nhieu san pham", "bao nhiêu cây", "bao nhieu cay", "bao nhiêu quyển", "bao nhieu quyen", "bao nhiêu người", "bao nhieu nguoi", "bao nhiêu năm", "bao nhieu nam",
    "bao nhiêu điểm", "bao nhieu diem", "bao nhiêu ô", "bao nhieu o", "bao nhiêu quả", "bao nhieu qua", "hỏi n bằng bao nhiêu", "hoi n bang bao nhieu",
)
SANITY = [(list(COUNTED), [(1e4, 3.0), (1e3, 1.5)]), (["xác suất", "xac suat", "tỉ số", "ti so"], [(1.5, 2.5)]), (["phần trăm", "phan tram"], [(1e4, 1.0)])]


def agreement_decision(used: Column, retrieved: Column, model: Column, agreement: Column, low: float = 0.5) -> Column:
    """struct(key, source): the retrieved key if it passed its gate and the model agrees, or is unsure; else the model's."""
    source = F.when(~F.coalesce(used, F.lit(False)), "model_consensus").when(retrieved.eqNullSafe(model), "retrieval_model_agree").when(agreement <= low, "retrieval_low_model_conf").otherwise("model_fallback_disagree")
    return F.struct(F.when(source.startswith("retrieval"), retrieved).otherwise(model).alias("key"), source.alias("source"))


def agreement_histogram(chosen: DataFrame, votes: str = "votes") -> DataFrame:
    """How many rows the chosen key got each number of votes in."""
    return chosen.groupBy(votes).agg(F.count("*").alias("rows"))


def seed_score(votes: Column, similarity: Column, prior: Column, penalty: Column) -> Column:
    """Score of a row's candidates before they are scored by likelihood; fixed weights."""
    return 10.0 * votes + 2.0 * similarity + prior - 0.5 * penalty
