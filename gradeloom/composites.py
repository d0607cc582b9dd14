"""Registered queries of strategies, selections, splits and report tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import text as T
from .operators import aggregate as G
from .operators import clean as P
from .operators import gates as H
from .operators import joins as J
from .operators import vote as V
from .plans import strategies as S
from .plans import trees as TR
from .queries import FRACTION, GATE, RUNS_SQL, SCORED_SQL, WORDS, gated, query, runs, scored, table
from .sources.readers import scratch

# Strategies: orders ask for the answer that their status tells; line items are hits and known answers.

HITS_SQL = """WITH hits AS (SELECT l_orderkey AS row, l_returnflag || l_linestatus AS a, l_quantity / 50 AS sim, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS seen FROM lineitem),
q AS (SELECT o_orderkey AS row, o_orderpriority AS family, o_custkey AS cust, CASE o_orderstatus WHEN 'O' THEN 'NO' WHEN 'F' THEN 'RF' ELSE 'AF' END AS gold, CASE WHEN o_totalprice > 200000 THEN 'RF' ELSE 'NO' END AS fallback FROM orders)
"""


def hits(spark, sf_dir):
    seen = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("a"), (F.col("l_quantity") / 50).alias("sim"), seen.alias("seen"))


def asked(spark, sf_dir):
    gold = F.when(F.col("o_orderstatus") == "O", "NO").when(F.col("o_orderstatus") == "F", "RF").otherwise("AF")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("cust"), gold.alias("gold"), F.when(F.col("o_totalprice") > 200000, "RF").otherwise("NO").alias("fallback"))


def judged(answer):
    """10 for the gold answer, 5 for its second letter, else 0."""
    return F.when(answer == F.col("gold"), 10).when(F.substring(answer, 2, 1) == F.substring("gold", 2, 1), 5).otherwise(0)


JUDGED = "CASE WHEN {0} = gold THEN 10 WHEN substr({0}, 2, 1) = substr(gold, 2, 1) THEN 5 ELSE 0 END"
MAJORITY_SQL = """, c AS (SELECT t, row, a, count(*) AS n, min(seen) AS seen FROM hits, (SELECT unnest([0.9, 0.7, 0.5])::DOUBLE AS t) WHERE sim >= t GROUP BY ALL),
near AS (SELECT t AS threshold, row, a AS candidate, sum(n) OVER (PARTITION BY t, row)::BIGINT AS kept FROM c QUALIFY row_number() OVER (PARTITION BY t, row ORDER BY n DESC, seen, a) = 1)
"""


@query(HITS_SQL + MAJORITY_SQL + "SELECT threshold, row, candidate, kept FROM near")
def nearest_majorities(spark, sf_dir):
    return S.nearest_majority(hits(spark, sf_dir), "row", "a", "sim", "seen", (0.9, 0.7, 0.5))


@query(HITS_SQL + MAJORITY_SQL + f""", e AS (SELECT q.cust, q.family, h.a, count(*) AS n, min(seen) AS seen FROM hits h JOIN q USING (row) GROUP BY ALL),
cust AS (SELECT cust, a FROM (SELECT cust, a, sum(n) AS n, min(seen) AS seen FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cust ORDER BY n DESC, seen, a) = 1),
both_keys AS (SELECT cust, family, a FROM e QUALIFY row_number() OVER (PARTITION BY cust, family ORDER BY n DESC, seen, a) = 1),
found AS (
  SELECT 'customer' AS strategy, row, a AS c FROM q JOIN cust USING (cust) UNION ALL SELECT 'customer_and_family', row, a FROM q JOIN both_keys USING (cust, family)
  UNION ALL SELECT printf('nearest_majority_%.2f', threshold), row, candidate FROM near
  UNION ALL SELECT 'top1', row, a FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY row ORDER BY sim DESC, seen, a DESC) = 1)
  UNION ALL SELECT 'oracle', row, a FROM (SELECT h.*, {JUDGED.format("a")} AS s FROM hits h JOIN q USING (row) QUALIFY row_number() OVER (PARTITION BY row ORDER BY s DESC, seen, a DESC) = 1)
), s AS (SELECT x.strategy, q.family, c, {JUDGED.format("coalesce(c, fallback)")} AS s FROM q CROSS JOIN (SELECT DISTINCT strategy FROM found) x LEFT JOIN found f ON f.row = q.row AND f.strategy = x.strategy)
SELECT strategy, family, grouping(family)::TINYINT AS over_all, count(*) AS n, sum(s)::BIGINT AS raw, round(sum(s) / count(*), 6) AS score_10, count(c) AS used, count(*) FILTER (s = 10) AS b10, count(*) FILTER (s = 5) AS b5, count(*) FILTER (s = 1) AS b1, count(*) FILTER (s = 0) AS b0 FROM s GROUP BY GROUPING SETS ((strategy, family), (strategy))""")
def strategies(spark, sf_dir):
    """Lookups by customer, by customer and family, thresholds, the nearest hit and the best one: all evaluated."""
    rows, found = asked(spark, sf_dir), hits(spark, sf_dir)
    entries = found.join(rows.select("row", "cust", "family"), "row")
    return S.analyze_source(rows, entries, found, "row", "a", "fallback", judged, "family", {"customer": ["cust"], "customer_and_family": ["cust", "family"]}, "sim", "seen", (0.9, 0.7, 0.5))


@query(HITS_SQL + """, g AS (SELECT row, a, count(*) AS n, max(sim) AS top FROM hits GROUP BY ALL), b AS (SELECT row, a, sim FROM hits QUALIFY row_number() OVER (PARTITION BY row ORDER BY sim DESC, seen, a DESC) = 1)
SELECT g.row, g.a, n, round(top, 6) AS top, round(b.sim, 6) AS nearest FROM g JOIN b ON b.row = g.row AND b.a = g.a""")
def nearest_groups(spark, sf_dir):
    found = hits(spark, sf_dir)
    groups = found.groupBy("row", "a").agg(F.count("*").alias("n"), F.max("sim").alias("top"))
    return V.nearest_group(found, groups, "row", "a", "sim", "seen").select("row", "a", "n", F.round("top", 6).alias("top"), F.round("nearest", 6).alias("nearest"))


@query(HITS_SQL + """, h AS (SELECT row, a, max(sim) AS j, count(*) AS n FROM hits GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY row) AS pool FROM h QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC, j DESC, a DESC) = 1)
SELECT q.row, family, CASE WHEN family = '5-LOW' THEN 'type_not_allowed' WHEN coalesce(pool, 0) < 2 THEN 'source_unseen' WHEN n / pool < 0.5 THEN 'low_majority' ELSE 'used' END AS reason,
CASE WHEN family != '5-LOW' AND pool >= 2 AND n / pool >= 0.5 THEN a END AS chosen, coalesce(pool, 0)::BIGINT AS pool, round(n / pool, 6) AS frac FROM q LEFT JOIN b ON b.row = q.row""")
def ungated_retrieval(spark, sf_dir):
    rows = asked(spark, sf_dir).select("row", "family")
    got = H.ungated_majority(hits(spark, sf_dir).withColumnRenamed("sim", "jaccard"), rows, "row", "a", F.col("family") != "5-LOW", 2, 0.5)
    return got.withColumn("frac", F.round("frac", 6))


@query(RUNS_SQL + GATE + """SELECT gate, sum(v)::BIGINT AS raw, count(*) FILTER (v = 10) AS tens, count(*) AS n FROM (
SELECT 'all' AS gate, gated AS v FROM x UNION ALL SELECT 'returned', CASE WHEN kind = 'R' THEN gated ELSE base END FROM x UNION ALL SELECT 'returned_and_none', CASE WHEN kind IN ('R', 'N') THEN gated ELSE base END FROM x) GROUP BY gate""")
def named_gates(spark, sf_dir):
    return H.named_gates(gated(spark, sf_dir), {"all": None, "returned": ["R"], "returned_and_none": ["R", "N"]}, "kind", "gated", "base")


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS solved, count(*) FILTER (o_totalprice <= 100000) AS unsolved FROM orders GROUP BY 1")
def solver_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("answer", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    solved, unsolved = H.split_solved(orders, "answer")
    both = solved.withColumn("s", F.lit(1)).unionAll(unsolved.withColumn("s", F.lit(0)))
    return both.groupBy("o_orderstatus").agg(F.sum("s").alias("solved"), F.count_if(F.col("s") == 0).alias("unsolved"))


# The verified override: an order's line items are candidates, its first one the model's (none for status P).

OVERRIDES_SQL = """WITH cands AS (SELECT l_orderkey AS row, l_partkey AS key, l_linenumber * 10000000000 + l_suppkey * 100000 + (l_extendedprice % 100000)::BIGINT AS ordinal, 0.7 + 3 * l_discount AS confidence, l_quantity / 50 AS prior_norm, -10 * l_tax AS logprob, l_returnflag AS flag,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000000 + l_suppkey * 100000 + (l_extendedprice % 100000)::BIGINT) END AS model_key FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT * FROM (VALUES {profiles}) t(profile, safe_confidence, least_confidence, tolerance, override_margin)),
m AS (SELECT row, key AS mkey, ordinal AS mo, logprob AS mlp FROM cands QUALIFY row_number() OVER (PARTITION BY row ORDER BY coalesce(key = model_key, false) DESC, ordinal) = 1),
f AS (SELECT c.*, p.*, mkey, logprob - mlp AS delta, ordinal = mo AS own, flag IN ('R', 'A') AS safe FROM cands c JOIN m USING (row), p),
r AS (SELECT *, model_key IS NULL AS missing, safe AND confidence >= safe_confidence AND delta >= -tolerance AS by_safety, confidence >= least_confidence AND delta >= override_margin AS by_likelihood, 2.0 * confidence + 0.30 * prior_norm + 0.75 * delta + CASE WHEN safe THEN 0.35 ELSE 0.0 END AS score FROM f),
best AS (SELECT profile, row, key AS k, CASE WHEN missing THEN 'model_missing' WHEN by_safety THEN 'safe_template_or_retrieval' ELSE 'logprob_override' END AS reason FROM r WHERE NOT own AND (missing OR by_safety OR by_likelihood) QUALIFY row_number() OVER (PARTITION BY profile, row ORDER BY round(score, 9) DESC, ordinal) = 1),
chosen AS (SELECT p.profile, m.row, coalesce(k, mkey) AS chosen, coalesce(reason, 'model_default') AS reason FROM m CROSS JOIN p LEFT JOIN best ON best.profile = p.profile AND best.row = m.row)
"""
PROFILES = {"strict": {"safe_confidence": 0.90, "least_confidence": 0.82, "tolerance": 0.35, "override_margin": 0.55}, "balanced": {"safe_confidence": 0.84, "least_confidence": 0.80, "tolerance": 0.50, "override_margin": 0.40}, "cautious": {"safe_confidence": 0.96, "least_confidence": 0.95, "tolerance": 0.10, "override_margin": 0.70}}


def overrides_sql(names: list[str]) -> str:
    return OVERRIDES_SQL.replace("{profiles}", ", ".join(f"('{n}', " + ", ".join(f"{PROFILES[n][k]}::DOUBLE" for k in ("safe_confidence", "least_confidence", "tolerance", "override_margin")) + ")" for n in names))


def override_candidates(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "R", "template_linear").when(F.col("l_returnflag") == "A", V.DIRECT).otherwise("query_arithmetic")
    ordinal = F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_suppkey") * 100000 + F.round(F.col("l_extendedprice") % 100000).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("key"), ordinal.alias("ordinal"), (0.7 + 3 * F.col("l_discount")).alias("confidence"), (F.col("l_quantity") / 50).alias("prior_norm"), (-10 * F.col("l_tax")).alias("logprob"), F.array(source).alias("sources"))
    first = lines.groupBy(F.col("row").alias("r")).agg(F.min_by("key", "ordinal").alias("first"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return lines.join(first, F.col("row") == F.col("r")).join(orders, F.col("row") == F.col("k")).withColumn("model_key", F.when(F.col("o_orderstatus") != "P", F.col("first"))).drop("r", "k", "first", "o_orderstatus")


@query(overrides_sql(["strict"]) + "SELECT row, chosen, reason FROM chosen")
def verified_overrides(spark, sf_dir):
    return V.verified_override(override_candidates(spark, sf_dir), "row", "key", "model_key", PROFILES["strict"])


@query(overrides_sql(list(PROFILES)) + """, gold AS (SELECT l_orderkey AS row, arg_max(l_partkey, l_extendedprice * 100000 + l_partkey) AS gold FROM lineitem GROUP BY 1),
s AS (SELECT profile, CASE WHEN chosen = gold THEN 10 WHEN chosen % 10 = gold % 10 THEN 1 ELSE 0 END AS s FROM chosen JOIN gold USING (row)),
g AS (SELECT profile, count(*) AS n, sum(s)::BIGINT AS raw, count(*) FILTER (s = 10) AS tens, count(*) FILTER (s = 0) AS zeros FROM s GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY raw DESC, tens DESC, zeros, profile) = 1 AS selected FROM g""")
def profile_runs(spark, sf_dir):
    """Each profile's verified overrides scored against the dearest line item's part, and the best profile."""
    cands = override_candidates(spark, sf_dir)
    gold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.max_by("l_partkey", F.col("l_extendedprice") * 100000 + F.col("l_partkey")).alias("gold"))
    score = lambda c: F.when(c == F.col("gold"), 10).when(c % 10 == F.col("gold") % 10, 1).otherwise(0)
    return S.run_profiles(V.verified_overrides(cands, "row", "key", "model_key", PROFILES), gold, "row", "chosen", score)


@query(f"""WITH r AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT conv_id AS doc_id, substr(text, 1, 40) AS r FROM conversations WHERE turn = 1),
j AS (SELECT r.doc_id, quality, t.r, t.r IS NOT NULL AS has_reasoning FROM r LEFT JOIN t USING (doc_id))
SELECT doc_id, coalesce(r || chr(10), '') || 'Đáp án là: ' || quality AS target, 'taught_or_fallback' AS stage, has_reasoning FROM j
UNION ALL SELECT doc_id, 'Đáp án là: ' || quality, 'replay', has_reasoning FROM j WHERE {FRACTION.format("doc_id::VARCHAR")} < 0.25""")
def distilled_records(spark, sf_dir):
    """Labelled documents with the second turn of the conversation of their number as reasoning, and a replay of the bare answers."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    taught = table(spark, sf_dir, "conversations").where("turn = 1").select(F.col("conv_id").alias("doc_id"), F.substring("text", 1, 40).alias("reasoning"))
    got = P.distilled_records(docs, taught, "doc_id", F.col("quality"), "reasoning", A.answer_target, 0.25)
    return got.select("doc_id", "target", "stage", "has_reasoning")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH t AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS q, l_suppkey::DOUBLE AS n, {PRIORITIES}[1 + l_linenumber % 5] AS r FROM lineitem),
d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS q, (o_custkey % 50)::DOUBLE AS n, o_orderpriority AS r FROM orders)
SELECT o_orderkey, q IN (SELECT q FROM t) AS seen_query, EXISTS (SELECT 1 FROM t WHERE t.q = d.q AND t.n = d.n) AS same_answer, EXISTS (SELECT 1 FROM t WHERE t.q = d.q AND t.r = d.r) AS same_response FROM d""")
def seen_flags(spark, sf_dir):
    """Orders' days, numbers and priorities that line items have too."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("q"), F.col("l_suppkey").alias("n"), F.element_at(F.array(*map(F.lit, PRIORITIES)), (1 + F.col("l_linenumber") % 5).cast("int")).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("q"), (F.col("o_custkey") % 50).cast("double").alias("n"), F.col("o_orderpriority").alias("r"))
    return J.seen_flags(orders, lines, "q", "n", "r").select("o_orderkey", "seen_query", "same_answer", "same_response")


# The ranker: an order's line items are candidates, named by their line numbers; their flags are the predictions.

RANKED_SQL = """WITH c AS (SELECT l_orderkey AS row, l_linenumber AS name, l_returnflag AS key, o_orderpriority AS type, CASE WHEN l_tax >= 0.06 THEN 10 WHEN l_tax >= 0.04 THEN 5 WHEN l_tax >= 0.02 THEN 1 ELSE 0 END AS score, l_partkey * 100000 + l_suppkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


def ranker_rows(spark, sf_dir):
    """row, name, key, type, score, part, agree (candidates of the row with the key) and n (of the row)."""
    tax = F.col("l_tax")
    score = F.when(tax >= 0.06, 10).when(tax >= 0.04, 5).when(tax >= 0.02, 1).otherwise(0)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("key"), score.alias("score"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("part"), "l_quantity")
    rows = lines.join(orders, F.col("row") == F.col("o_orderkey")).drop("o_orderkey")
    return rows.withColumn("agree", F.count("*").over(W.partitionBy("row", "key"))).withColumn("n", F.count("*").over(W.partitionBy("row")))


def ranker_candidates(spark, sf_dir):
    """The rows with raw, the name's total."""
    rows = ranker_rows(spark, sf_dir)
    totals = rows.groupBy(F.col("name").alias("__n")).agg(F.sum("score").alias("raw"))
    return rows.join(totals, F.col("name") == F.col("__n")).drop("__n")


@query(RANKED_SQL + """, t AS (SELECT type, name, avg(score / 10) AS m FROM c GROUP BY ALL), b AS (SELECT name, avg(score / 10) AS m, sum(score) AS raw FROM c GROUP BY ALL),
s AS (SELECT c.*, b.raw, round(0.60 * t.m + 0.35 * b.m + 0.04 * count(*) OVER (PARTITION BY row, key) / count(*) OVER (PARTITION BY row), 9) AS s FROM c JOIN t USING (type, name) JOIN b USING (name))
SELECT row, name AS chosen, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY s DESC, raw DESC, name, part DESC) = 1""")
def fallback_choices(spark, sf_dir):
    """Per order the candidate of the largest table score: means by type and name, by name, and agreement."""
    cands = ranker_candidates(spark, sf_dir)
    by_type = cands.groupBy(F.col("type").alias("t"), F.col("name").alias("tn")).agg(F.avg(F.col("score") / 10).alias("type_mean"))
    by_name = cands.groupBy(F.col("name").alias("bn")).agg(F.avg(F.col("score") / 10).alias("name_mean"))
    told = cands.join(by_type, (F.col("type") == F.col("t")) & (F.col("name") == F.col("tn"))).join(by_name, F.col("name") == F.col("bn"))
    value = F.round(0.60 * F.col("type_mean") + 0.35 * F.col("name_mean") + 0.04 * F.col("agree") / F.col("n"), 9)
    return V.pick(told, "row", "name", value, [F.col("raw"), -F.col("name"), F.col("part")]).select("row", "chosen", F.round("score", 6).alias("score"))


@query()
def ranker_choices(spark, sf_dir):
    """The same by randomised trees over agreement, priors, sizes, and the names and types as columns of 1 and 0."""
    cands = ranker_rows(spark, sf_dir)
    same = ["name", "key", "type", "agree", "n", "l_quantity"]  # candidates alike in these have one rank score

    def saved(df, name):
        df.write.parquet(path := scratch(spark, name))
        return spark.read.schema(df.schema).parquet(path)

    kinds = saved(cands.groupBy(*same, "score").agg(F.count("*").alias("times")), "ranker-kinds")
    totals = kinds.groupBy(F.col("name").alias("__n")).agg(F.sum(F.col("score") * F.col("times")).alias("raw"))
    priors = kinds.groupBy(F.col("key").alias("pk")).agg(F.log1p(F.sum("times")).alias("prior"))
    told = kinds.join(totals, F.col("name") == F.col("__n")).join(priors, F.col("key") == F.col("pk")).withColumns({"agree_part": F.col("agree") / F.col("n"), "agree_count": F.col("agree").cast("double"), "rank_part": F.col("name") / 8, "whole": F.log1p("l_quantity")})
    types = sorted(r.type for r in kinds.select("type").where("type IS NOT NULL").distinct().collect())  # the kinds of a fixed list
    rows, hot = TR.one_hot(told, {"name": list(range(1, 8)), "type": types})
    forest = TR.fit(rows.withColumn("y", F.col("score") / 10), ["agree_part", "agree_count", "rank_part", "prior", "whole", *hot], "y", trees=12, depth=5, times="times")
    ranked = saved(forest.predict(rows.select(*same, "raw", *forest.features).distinct()).select(*(F.col(c).alias(f"of_{c}") for c in same), "raw", "rank_score"), "ranker-scores")
    found = cands.join(ranked, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in same])
    return V.pick(found, "row", "name", F.round("rank_score", 9), [F.col("raw"), -F.col("name"), F.col("part")]).select("row", "chosen", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT l_orderkey AS row, l_returnflag AS key, 0.8 + l_quantity / 250 AS s, 0.5 + 6 * l_tax AS j, l_linenumber % 2 = 0 AS a, l_suppkey % 3 = 0 AS b, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS o FROM lineitem),
g AS (SELECT row, key, count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, max(s) AS s, max(j) AS j, min(o) AS o FROM h GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY row) AS hits, row_number() OVER w AS rank, lead(n, 1, 0) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY row ORDER BY n DESC, a DESC, b DESC, s DESC, j DESC, o, key)),
m AS (SELECT *, n / hits AS frac, CASE WHEN rank = 1 THEN (n - nxt) / hits ELSE 0.0 END AS margin FROM r),
c AS (SELECT *, least(1.0, 0.50 * s + 0.18 * j + 0.18 * frac + 0.10 * margin + CASE WHEN a > 0 THEN 0.12 ELSE 0.0 END + CASE WHEN b > 0 THEN 0.08 ELSE 0.0 END) AS conf, s >= 0.92 AND j >= 0.70 AND frac >= 0.55 AND margin >= 0.20 AND (a > 0 OR b > 0) AS safe FROM m)
SELECT row, key, CASE WHEN safe THEN 'retrieval_direct_safe' ELSE 'retrieval_group' END AS source, round(CASE WHEN safe THEN greatest(conf, 0.94) ELSE conf END, 6) AS confidence, rank FROM c WHERE rank <= 2""")
def retrieval_candidates(spark, sf_dir):
    """The two largest groups of an order's line items by flag; some are directly safe."""
    seen = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("key"), (0.8 + F.col("l_quantity") / 250).alias("similarity"), (0.5 + 6 * F.col("l_tax")).alias("jaccard"), (F.col("l_linenumber") % 2 == 0).alias("same_numbers"), (F.col("l_suppkey") % 3 == 0).alias("same_skeleton"), seen.alias("ordinal"))
    return V.retrieval_candidates(hits, "row", "key", 2, "ordinal").select("row", "key", "source", F.round("confidence", 6).alias("confidence"), "rank")


FACT_PROFILES = {"strict": {"safe_confidence": 0.90, "least_confidence": 0.99, "tolerance": 0.35, "override_margin": 0.55}, "wide": {"safe_confidence": 0.84, "least_confidence": 0.99, "tolerance": 0.50, "override_margin": 0.40, "least_sim": 0.5, "least_jaccard": 0.3, "direct_confidence": 0.9}, "filled": {"safe_confidence": 0.9, "least_confidence": 0.8, "tolerance": 0.1, "override_margin": 0.1, "allow_missing": False}}


def fact_profiles_sql() -> str:
    names = ("safe_confidence", "least_confidence", "tolerance", "override_margin", "least_sim", "least_jaccard", "direct_confidence")
    rows = ", ".join(f"('{n}', " + ", ".join(f"{({**V.PROFILE, **p})[k]}::DOUBLE" for k in names) + f", {str(p.get('allow_missing', True)).lower()})" for n, p in FACT_PROFILES.items())
    sql = OVERRIDES_SQL.replace("{profiles}", rows).replace("override_margin)", "override_margin, least_sim, least_jaccard, direct_confidence, allow_missing)").replace("l_returnflag AS flag", "l_returnflag AS flag, l_quantity / 50 AS fs, 10 * l_discount AS fj, l_linenumber % 2 AS odd")
    facts = "fs >= least_sim AND fj >= least_jaccard AND odd > 0"
    sql = sql.replace("flag IN ('R', 'A') AS safe", f"flag = 'R' OR ({facts}) AS safe, CASE WHEN {facts} THEN greatest(confidence, direct_confidence) ELSE confidence END AS conf")
    for old in ("safe AND confidence >=", "confidence >= least_confidence", "2.0 * confidence +"):
        sql = sql.replace(old, old.replace("confidence", "conf", 1))
    return sql.replace("model_key IS NULL AS missing", "model_key IS NULL AND allow_missing AS missing")


@query(fact_profiles_sql() + "SELECT profile, row, chosen, reason FROM chosen")
def profiles_with_facts(spark, sf_dir):
    """Overrides by three profiles that judge each candidate's retrieval facts; one takes no candidate where the model has none."""
    lines = table(spark, sf_dir, "lineitem")
    ordinal = F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_suppkey") * 100000 + F.round(F.col("l_extendedprice") % 100000).cast("long")
    facts = F.array(F.struct((F.col("l_quantity") / 50).alias("top_sim"), (10 * F.col("l_discount")).alias("top_jaccard"), F.lit(0.6).alias("frac"), F.lit(0.3).alias("margin"), (F.col("l_linenumber") % 2).alias("same_numbers"), F.lit(0).alias("same_skeleton")))
    told = lines.select(F.col("l_orderkey").alias("fact_row"), F.col("l_partkey").alias("fact_key"), ordinal.alias("fact_ordinal"), facts.alias("facts"))
    cands = override_candidates(spark, sf_dir)
    both = cands.join(told, (F.col("row") == F.col("fact_row")) & (F.col("key") == F.col("fact_key")) & (F.col("ordinal") == F.col("fact_ordinal")))
    return V.verified_overrides(both, "row", "key", "model_key", FACT_PROFILES, "facts")


@query("""WITH c AS (SELECT l_orderkey AS row, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag = 'R' AS own, l_discount FROM lineitem)
SELECT row, l_linenumber, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY own DESC, l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM c) WHERE place <= 3""")
def model_first_candidates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "row")
    got = V.model_first(lines, "row", F.col("l_returnflag") == "R", [F.desc("l_discount"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3)
    return got.select("row", "l_linenumber", "l_partkey", "place")


# Report tables.


@query(SCORED_SQL + """SELECT * FROM (SELECT 'Parse failure' AS error, min(o_orderkey) FILTER (pred IS NULL) AS id FROM s UNION ALL SELECT 'Arithmetic error', min(o_orderkey) FILTER (score IN (1, 5)) FROM s
UNION ALL SELECT 'Relation error', min(o_orderkey) FILTER (score = 0 AND type IN ('1-URGENT', '2-HIGH')) FROM s) WHERE id IS NOT NULL""")
def error_examples(spark, sf_dir):
    named = {"Parse failure": F.col("pred").isNull(), "Arithmetic error": F.col("score").isin(1, 5), "Relation error": (F.col("score") == 0) & F.col("type").isin("1-URGENT", "2-HIGH")}
    return V.first_of_each(scored(spark, sf_dir), "o_orderkey", named, "o_orderkey")


@query("""WITH o AS (SELECT s_nationkey AS path, min((coalesce(CASE WHEN s_acctbal > 0 THEN floor(s_acctbal / 1000) END, 1e9), (s_acctbal > 5000)::INT, s_name)) AS k FROM supplier GROUP BY 1) SELECT path, k[1] AS epoch, k[2] AS final, k[3] AS name FROM o ORDER BY k[1] DESC, k[2] DESC, k[3] DESC LIMIT 12""")
def latest_checkpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000)).alias("epoch"), (F.col("s_acctbal") > 5000).alias("final"), F.col("s_name").alias("name"))
    return V.ordered_checkpoints(rows, "path", "epoch", "final", "name", 12)


@query("""WITH e AS (SELECT p_partkey, 'epoch_' || p_size AS label, p_retailprice FROM part WHERE p_type != 'SMALL'), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY p_partkey) = 1) SELECT label, p_partkey, p_retailprice FROM f ORDER BY p_retailprice DESC, label LIMIT 20""")
def unique_epochs(spark, sf_dir):
    label = F.when(F.col("p_type") != "SMALL", F.concat(F.lit("epoch_"), F.col("p_size").cast("string"))).otherwise("final")
    parts = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), "p_retailprice")
    return V.unique_entries(parts, "label", [F.desc("p_retailprice"), F.col("label")], "p_partkey", "p_partkey", 20).select("label", "p_partkey", "p_retailprice")


@query("""SELECT c_nationkey AS run, c_name AS label, c_acctbal AS score, c_name = first_value(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name DESC) AS selected FROM customer""")
def checkpoint_curve(spark, sf_dir):
    entry = F.struct(F.col("c_name").alias("label"), F.col("c_acctbal").alias("score"))
    reports = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.max(F.struct("c_acctbal", "c_name")).alias("m"), F.collect_list(entry).alias("all"))
    return V.checkpoint_curve(reports.withColumn("best", F.col("m.c_name")), "run", "best", "all")


@query("""WITH p AS (SELECT s_nationkey, ('0' || regexp_extract(replace(s_name, ',', ''), '-?\\d+(\\.\\d+)?'))::DOUBLE AS simple, CASE WHEN s_acctbal > 2000 THEN s_suppkey::DOUBLE END AS robust FROM supplier)
SELECT s_nationkey, count(*) AS n, count(simple) AS simple_numeric, count(robust) AS robust_numeric, count(*) FILTER (simple IS DISTINCT FROM robust) AS mismatch, count(*) FILTER (simple IS NOT NULL AND robust IS NOT NULL) AS both,
count(*) FILTER (simple IS NOT NULL AND robust IS NULL) AS simple_only, count(*) FILTER (simple IS NULL AND robust IS NOT NULL) AS robust_only, count(*) FILTER (simple IS NULL AND robust IS NULL) AS neither FROM p GROUP BY 1""")
def parser_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", A.simple_number("s_name").alias("simple"), F.when(F.col("s_acctbal") > 2000, F.col("s_suppkey").cast("double")).alias("robust"))
    return G.parser_audit(rows, "simple", "robust", ["s_nationkey"])


@query("""WITH t AS (SELECT p_name, count(*) AS n, sum(p_size)::BIGINT AS raw FROM part GROUP BY 1),
a AS (SELECT p_name, p_brand, count(*) AS c, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, min(p_partkey), p_brand) AS p FROM part GROUP BY 1, 2),
e AS (SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) <= 5)
SELECT p_name, n, raw, round(raw / n, 6) AS score_10, (SELECT string_agg(p_brand || '=' || c, ';' ORDER BY p) FROM a WHERE a.p_name = t.p_name AND p <= 10) AS top_answers, (SELECT string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FROM e WHERE e.p_name = t.p_name) AS examples FROM t""")
def template_summary(spark, sf_dir):
    return G.by_template(table(spark, sf_dir, "part"), "p_name", "p_brand", "p_size", "p_partkey")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (e = 0) AS fallback_answer_only, count(*) FILTER (e = 1) AS one_equation, count(*) FILTER (e >= 2) AS multi_equation, round(avg(tokens), 6) AS target_tokens_mean, max(tokens) AS target_tokens_max
FROM (SELECT o_orderpriority, coalesce(e, 0) AS e, (o_custkey % 97) AS tokens FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")
def target_summary(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("e"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 97).alias("tokens")).join(e, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderpriority").agg(*G.target_meta("e", "tokens"))


@query(r"""SELECT role, count(*) AS n, count(*) FILTER (trim(text) != '') AS filled, count(*) FILTER (regexp_matches(text, '[0-9]')) AS has_digit, count(*) FILTER (contains(text, chr(10))) AS multiline, count(*) FILTER (length(text) > 40) AS long,
count(*) FILTER (NOT contains(trim(text), chr(10)) AND length(trim(text)) <= 40) AS single_short, count(DISTINCT text) AS unique_outputs, round(avg(length(text)), 6) AS mean_chars, max(length(text))::INT AS most_chars FROM conversations GROUP BY role""")
def output_behaviour(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(*G.output_stats(F.col("text")))


SPLIT_SQL = f"SELECT *, {FRACTION.format("'split:' || doc_id")} < 0.1 AS held FROM documents"


@query(f"""SELECT lang, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_valid, count(DISTINCT source) AS n_groups, round(avg(n_chars), 2) AS mean_chars, round(avg(len(regexp_extract_all(lower(text), '{WORDS}'))), 2) AS mean_words FROM ({SPLIT_SQL}) GROUP BY lang""")
def language_table(spark, sf_dir):
    split = P.hash_split(table(spark, sf_dir, "documents"), "doc_id", 0.1)
    return G.kind_table(split.where("not held"), split.where("held"), "lang", "source", {"mean_chars": F.col("n_chars"), "mean_words": F.size(T.words("text"))})


@query("SELECT lang, count(*) AS n, count(quality) AS covered, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return G.coverage(docs, "lang", F.col("quality").isNotNull())


@query("SELECT user_id, count(*) FILTER (event_type IN ('click', 'view', 'error')) AS n_cells, round(coalesce(sum(value) FILTER (event_type IN ('click', 'view', 'error')), 0.0), 6) AS total_seconds FROM events GROUP BY user_id")
def cell_seconds(spark, sf_dir):
    """Durations in three places of a cell's metadata; other events hold one that is no number."""
    v, kind = F.col("value"), F.col("event_type")
    tree = F.when(kind == "click", F.to_json(F.struct(v.alias("duration")))).when(kind == "view", F.to_json(F.struct(F.struct(v.alias("duration")).alias("papermill")))).when(kind == "error", F.to_json(F.struct(F.struct(v.alias("duration")).alias("execution")))).otherwise('{"duration": "long"}')
    return G.notebook_runtime(table(spark, sf_dir, "events").withColumn("tree", tree), "user_id", "tree")


@query(SCORED_SQL + """SELECT coalesce(CASE WHEN l_returnflag != 'N' THEN l_returnflag END, '<missing>') AS source, count(*) AS n, sum(score)::BIGINT AS raw, count(*) FILTER (score = 10) AS b10, count(*) FILTER (score = 5) AS b5, count(*) FILTER (score = 1) AS b1, count(*) FILTER (score = 0) AS b0 FROM lineitem JOIN s ON o_orderkey = l_orderkey GROUP BY 1""")
def decision_sources(spark, sf_dir):
    decisions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("source"))
    return G.decision_sources(decisions, scored(spark, sf_dir).withColumnRenamed("o_orderkey", "id"), "id", "source", "score")


@query(f"""WITH w AS (SELECT conv_id, turn, role, text, length(text) AS num, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM conversations),
u AS (SELECT * FROM w WHERE role = 'user'), a AS (SELECT * FROM w WHERE role != 'user'),
s AS (SELECT u.conv_id, u.turn, max(CASE WHEN len(u.w) = 0 OR len(a.w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(u.w, a.w)) / (len(u.w) + len(a.w) - len(list_intersect(u.w, a.w))) END) AS m, bool_or(a.num = u.num) AS same FROM u JOIN a USING (conv_id) GROUP BY 1, 2)
SELECT conv_id * 1000 + turn AS row, u.text IN (SELECT text FROM a) AS query_seen, s.m IS NOT NULL AS group_seen, round(coalesce(s.m, 0.0), 6) AS max_similarity, CASE WHEN s.m IS NULL THEN 'unseen' WHEN same THEN 'same' ELSE 'conflict' END AS overlap FROM u LEFT JOIN s USING (conv_id, turn)""")
def overlap_rows(spark, sf_dir):
    """Users' turns against the other turns: of equal text, and of their own conversation."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "conv_id", "role", "text", F.length("text").alias("num"))
    similarity = lambda a, b: T.jaccard(T.words(a, distinct=True), T.words(b, distinct=True))
    got = G.overlap_rows(turns.where("role = 'user'"), turns.where("role != 'user'"), "row", "conv_id", "text", "num", similarity)
    return got.withColumn("max_similarity", F.round("max_similarity", 6))


@query()
def sequence_overlap(spark, sf_dir):
    """Users' turns with the largest sequence ratio to another turn of their conversation, beside what ``overlap_rows`` tells."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "conv_id", "role", "text", F.length("text").alias("num"))
    got = G.overlap_rows(turns.where("role = 'user'"), turns.where("role != 'user'"), "row", "conv_id", "text", "num")
    return got.withColumn("max_similarity", F.round("max_similarity", 6))


# Records, splits and alignments.


@query(f"""SELECT doc_id, 'Đáp án là: ' || quality AS answer_only, CASE WHEN {FRACTION.format("'stage_b:' || doc_id")} < 0.4 THEN 'compact_equation' ELSE 'answer_only' END AS target_mode,
CASE WHEN {FRACTION.format("'stage_b:' || doc_id")} < 0.4 THEN quality || ' = ' || quality || chr(10) || 'Đáp án là: ' || quality ELSE 'Đáp án là: ' || quality END AS target, 'stage_b' AS stage FROM labels JOIN documents USING (doc_id)""")
def stage_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = P.with_target(docs, F.col("quality"), A.answer_target("quality"), "stage_b").withColumnRenamed("target", "answer_only")
    text = F.col("quality").cast("string")
    compact = F.concat(text, F.lit(" = "), text, F.lit("\n"), F.col("answer_only"))
    return P.mode_mix(rows, "doc_id", "stage_b", compact, F.col("answer_only"), 0.4).select("doc_id", "answer_only", "target_mode", "target", "stage")


@query("""SELECT coalesce(CASE WHEN p_size > 10 THEN p_partkey END, p_partkey) AS id, p_partkey AS position, p_type FROM part WHERE CASE WHEN p_size > 5 THEN p_type ELSE 'unknown' END IN ('SMALL', 'unknown')""")
def expert_records(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 10, F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("o"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("kind"), "p_type")
    return P.of_kinds(parts, "kind", ["SMALL", "unknown"], "id", "o").select("id", "position", "p_type")


@query("SELECT 'orders' AS source, o_orderkey AS position, o_orderpriority AS query, o_totalprice::VARCHAR AS key FROM orders WHERE o_orderstatus != 'P' AND o_orderpriority != '5-LOW'")
def index_entries(spark, sf_dir):
    some = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", some.alias("q"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")).alias("k"))
    return P.source_entries(orders, "orders", "o_orderkey", "q", "k")


@query("""SELECT id, type, '#### ' || coalesce(gold::VARCHAR, 'None') AS response, gold AS num FROM (SELECT o_orderkey AS id, o_orderpriority AS type, CASE WHEN o_orderstatus != 'P' THEN o_custkey END AS gold FROM orders)""")
def report_gold(spark, sf_dir):
    """Gold rows made of a report's, and the numbers that the extractor finds in them."""
    report = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("gold_answer"))
    rows = P.gold_from_report(report)
    return rows.withColumn("num", A.extracted("response")["num"].cast("long"))


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM documents), l AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS o FROM labels)
SELECT doc_id, quality, 'id' AS by FROM labels UNION ALL SELECT x.doc_id, quality, 'place' FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM labels) x JOIN l USING (o)""")
def aligned_labels(spark, sf_dir):
    """Labels as predictions of documents: by id where all rows have one, by place where one lacks it."""
    labels = table(spark, sf_dir, "labels").withColumn("o", F.col("doc_id"))
    gold = labels.select("doc_id", "o")
    by_id = J.align_as_given(gold, labels, "doc_id", "o").select("doc_id", "pred.quality", F.lit("id").alias("by"))
    nameless = labels.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    by_place = J.align_as_given(gold, nameless, "doc_id", "o").select("doc_id", "pred.quality", F.lit("place").alias("by"))
    return by_id.unionAll(by_place)


@query("""WITH c AS (SELECT l_orderkey AS row, l_returnflag AS key FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey AS row, l_returnflag AS key, max(l_tax) AS lp FROM lineitem WHERE l_discount > 0.04 GROUP BY 1, 2)
SELECT c.row, c.key, lp FROM c LEFT JOIN s USING (row, key)""")
def cached_scores(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("key"), F.col("l_tax").alias("lp"), "l_discount")
    return J.with_scores(lines.select("row", "key").distinct(), lines.where("l_discount > 0.04").groupBy("row", "key").agg(F.max("lp").alias("lp")), ["row", "key"], "lp")


@query("""WITH h AS (SELECT l_orderkey AS row, l_linenumber AS no, l_returnflag = 'R' AS same FROM lineitem), p AS (SELECT * FROM h QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY row))
SELECT row, count(*) AS n, bool_or(same) AS typed FROM p GROUP BY row""")
def typed_pools(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), (F.col("l_returnflag") == "R").alias("same"))
    return H.typed_pool(found, "row", F.col("same")).groupBy("row").agg(F.count("*").alias("n"), F.bool_or("same").alias("typed"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'has_same' WHEN bool_or(o_orderstatus = 'O') THEN 'only_conflict' WHEN bool_or(o_orderstatus = 'P') THEN 'only_missing' ELSE 'no_match' END AS flag FROM orders GROUP BY 1""")
def flag_classes(spark, sf_dir):
    s = F.col("o_orderstatus")
    any_of = lambda v: F.bool_or(s == v)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(G.flag_class(any_of("F"), any_of("O"), any_of("P")).alias("flag"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, o_orderstatus, n, sum(n) OVER (PARTITION BY o_custkey) AS votes FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) = 1)
SELECT o_custkey, o_orderstatus AS top_answer, round(n / votes, 6) AS frac, round(0.8 * n / votes, 6) AS confidence FROM m WHERE n / votes >= 0.6""")
def confident_majorities(spark, sf_dir):
    found = V.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")
    return V.gated_majority(found, 0.6, 0.8).select("o_custkey", "top_answer", F.round("frac", 6).alias("frac"), F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id, text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND text IS NOT NULL) OR text IS NULL")
def without_leaked_texts(spark, sf_dir):
    """Documents whose text no toxic document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return J.unseen_in(docs, toxic, "text").select("doc_id", "text")


@query(HITS_SQL + """, g AS (SELECT row, a, count(*) AS n, max(sim) AS top, sum(count(*)) OVER (PARTITION BY row) AS total FROM hits GROUP BY row, a), r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC, top DESC, a) = 1),
x AS (SELECT q.row, fallback AS model, (cust % 10) / 10 AS agreement, r.a AS retrieved, coalesce(top >= 0.8 AND n / total >= 0.4, false) AS used FROM q LEFT JOIN r USING (row)),
d AS (SELECT *, CASE WHEN NOT used THEN 'model_consensus' WHEN retrieved IS NOT DISTINCT FROM model THEN 'retrieval_model_agree' WHEN agreement <= 0.5 THEN 'retrieval_low_model_conf' ELSE 'model_fallback_disagree' END AS source FROM x)
SELECT row, CASE WHEN source LIKE 'retrieval%' THEN retrieved ELSE model END AS key, source FROM d""")
def hybrid_decisions(spark, sf_dir):
    """Retrieved answers against the model's: taken if both agree or the model is unsure."""
    groups = hits(spark, sf_dir).groupBy("row", "a").agg(F.count("*").alias("n"), F.max("sim").alias("top"))
    best = groups.groupBy(F.col("row").alias("r")).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("top")).alias("top"), "a")).alias("m"), F.sum("n").alias("total"))
    rows = asked(spark, sf_dir).join(best, F.col("row") == F.col("r"), "left")
    used = (-F.col("m.top") >= 0.8) & (-F.col("m.n") / F.col("total") >= 0.4)
    return rows.select("row", V.agreement_decision(used, F.col("m.a"), F.col("fallback"), (F.col("cust") % 10) / 10).alias("d")).select("row", "d.key", "d.source")


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS votes, max(event_id) AS priority FROM events GROUP BY 1, 2), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, priority DESC) = 1) SELECT votes, count(*) AS rows FROM c GROUP BY votes""")
def agreement_counts(spark, sf_dir):
    return V.agreement_histogram(V.consensus(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id"))


def lookup_sql(keys: str) -> str:
    return f"(SELECT {keys}, p_brand AS a, count(*) AS n, min(p_partkey) AS seen FROM t GROUP BY {keys}, p_brand QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(p_partkey), p_brand) = 1)"


@query(f"""WITH t AS (SELECT p_partkey, p_brand, lower('Mua ' || p_size || ' ' || p_name) AS norm, 'Mua <NUM> ' || p_name AS mask, p_size::VARCHAR AS numbers FROM part)
SELECT t.p_partkey, x.a AS by_norm, y.a AS by_mask, z.a AS by_mask_numbers FROM t JOIN {lookup_sql("norm")} x USING (norm) JOIN {lookup_sql("mask")} y USING (mask) JOIN {lookup_sql("mask, numbers")} z ON z.mask = t.mask AND z.numbers = t.numbers""")
def mask_lookups(spark, sf_dir):
    """The most frequent answer of questions of equal text, of equal mask, and of equal mask and numbers."""
    text = F.concat(F.lit("Mua "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", T.text_key(text).alias("norm"), T.mask_numbers(text).alias("mask"), F.array_join(T.numbers(text), "|").alias("numbers"))
    out = rows.select("p_partkey")
    for name, keys in (("by_norm", ["norm"]), ("by_mask", ["mask"]), ("by_mask_numbers", ["mask", "numbers"])):
        out = out.join(S.majority_lookup(rows, rows, keys, "p_partkey", "p_brand", "p_partkey").withColumnRenamed("candidate", name), "p_partkey")
    return out


@query(RUNS_SQL + "SELECT run, count(*) AS n, sum(score)::BIGINT AS raw_score, round(sum(score) / count(*), 6) AS score_10, count(*) FILTER (score = 10) AS b10, count(*) FILTER (score = 5) AS b5, count(*) FILTER (score = 1) AS b1, 0 AS b0 FROM runs GROUP BY run")
def report_summaries(spark, sf_dir):
    """Summaries of runs as JSON reports, plucked again; their buckets lack zeros."""
    from .sources import readers as R

    sums = runs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.sum("score").alias("raw_score"), F.round(F.avg("score"), 6).alias("score_10"), *(F.count_if(F.col("score") == k).alias(f"c{k}") for k in (10, 5, 1)))
    buckets = F.create_map(*(x for k in (10, 5, 1) for x in (F.lit(str(k)), F.col(f"c{k}"))))
    tree = F.to_json(F.struct(F.struct("n", "raw_score", "score_10", buckets.alias("buckets")).alias("summary")))
    nothing = spark.createDataFrame([("none", "{}")], "run string, tree string")
    return R.report_summaries(sums.select("run", tree.alias("tree")).unionAll(nothing), "tree")


@query("SELECT n_nationkey, (n_nationkey - 12 + 25) % 25 AS turn FROM nation WHERE (n_nationkey - 12 + 25) % 25 < 4 UNION ALL SELECT n_nationkey, (n_nationkey - 24 + 25) % 25 FROM nation WHERE (n_nationkey - 24 + 25) % 25 < 4")
def cyclic_batches(spark, sf_dir):
    """Two batches of four nations, the second of which begins again at the first nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    return J.union_all([P.cyclic_batch(nations, "n_nationkey", 25, step, 4) for step in (3, 6)])


@query("""SELECT o_orderpriority, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 0.5::DOUBLE WHEN '5-LOW' THEN 0.9::DOUBLE END, 0.34::DOUBLE) AS majority, CASE o_orderpriority WHEN '5-LOW' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS jaccard FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def kind_configs(spark, sf_dir):
    """Settings of every kind: its own, else the default."""
    own = spark.createDataFrame([("1-URGENT", 0.5, None), ("5-LOW", 0.9, 0.45)], "o_orderpriority string, majority double, jaccard double")
    return H.configs_for(table(spark, sf_dir, "orders"), "o_orderpriority", {"majority": 0.34, "jaccard": 0.0}, own)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 50")
def missing_predictions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.missing_keys(table(spark, sf_dir, "orders"), lines, "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey AS row, l_partkey, l_linenumber, l_suppkey, 10.0 * l_quantity + 2.0 * l_discount + l_tax - 0.5 * (l_linenumber % 3) AS score FROM lineitem)
SELECT row, l_partkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY round(score, 9) DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM c) WHERE place <= 5""")
def seed_candidates(spark, sf_dir):
    score = V.seed_score(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") % 3)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "row").withColumn("score", F.round(score, 9))
    return V.top_k(lines, "row", [F.desc("score"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 5).select("row", "l_partkey", "l_linenumber", "place")


@query(SCORED_SQL + "SELECT score, l_returnflag, count(*) AS n FROM s JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1, 2")
def labelled_predictions(spark, sf_dir):
    """Labels of solved rows beside the scores of their predictions; rows without a label are left out."""
    labels = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return scored(spark, sf_dir).join(labels, "o_orderkey").groupBy("score", "l_returnflag").agg(F.count("*").alias("n"))
