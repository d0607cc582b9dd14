"""The registered queries over the driver's tables, with the SQL that tells their right results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import solver as S
from .functions import text as T
from .operators import aggregate as G
from .operators import clean as P
from .operators import gates as H
from .operators import joins as J
from .operators import vote as V
from .plans import retrieval as R
from .plans.retriever import Grams, Retriever
from .sources.readers import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same rows if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scoring: an order's total price is the gold, its line items' revenue the prediction.

SCORED_SQL = """
WITH pred AS (SELECT l_orderkey, sum(l_extendedprice) AS pred FROM lineitem GROUP BY l_orderkey),
scored AS (
  SELECT o_orderkey, o_orderpriority AS type, o_totalprice AS gold, pred, abs(pred - o_totalprice) / greatest(1.0, abs(o_totalprice)) AS rel_error
  FROM orders LEFT JOIN pred ON l_orderkey = o_orderkey
), s AS (SELECT *, CASE WHEN rel_error IS NULL THEN 0 WHEN rel_error <= 0.01 THEN 10 WHEN rel_error <= 0.10 THEN 5 WHEN rel_error <= 0.50 THEN 1 ELSE 0 END AS score FROM scored)
"""
SUMMARY_SQL = """count(*) AS n, sum(score)::BIGINT AS raw_score, 10 * count(*) AS max_raw_score, round(sum(score) / count(*), 6) AS score_10,
  count(pred) AS extractable, count(rel_error) AS numeric_pairs, count(*) FILTER (score = 10) AS bucket_10, count(*) FILTER (score = 5) AS bucket_5,
  count(*) FILTER (score = 1) AS bucket_1, count(*) FILTER (score = 0) AS bucket_0, round(avg(rel_error), 6) AS rel_error_mean"""
QUANTILE_SQL = """round(quantile_cont(rel_error, 0.5), 6) AS err_p50, round(quantile_cont(rel_error, 0.9), 6) AS err_p90, round(quantile_cont(rel_error, 0.95), 6) AS err_p95, round(max(rel_error), 6) AS err_max"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("pred"))
    gold = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("gold"))
    rows = gold.join(pred, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return rows.withColumn("rel_error", A.rel_error("pred", "gold")).withColumn("score", A.score("rel_error"))


@query(SCORED_SQL + f"SELECT {SUMMARY_SQL} FROM s")
def score_summary(spark, sf_dir):
    return scored(spark, sf_dir).agg(*G.score_summary(extractable=F.col("pred").isNotNull()))


@query(SCORED_SQL + f"SELECT type, {SUMMARY_SQL}, {QUANTILE_SQL} FROM s GROUP BY type")
def score_by_type(spark, sf_dir):
    summary = G.score_summary(extractable=F.col("pred").isNotNull())
    return G.with_quantiles(scored(spark, sf_dir), "type", "rel_error", G.ERROR_POINTS, [*summary, F.round(F.max("rel_error"), 6).alias("err_max")])


@query(SCORED_SQL + "SELECT type, o_orderkey, round(rel_error, 6) AS rel_error, place FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rel_error DESC NULLS FIRST, o_orderkey) AS place FROM s WHERE score = 0) WHERE place <= 5")
def worst_examples(spark, sf_dir):
    bad = scored(spark, sf_dir).where("score = 0")
    return V.top_k(bad, "type", [F.col("rel_error").desc_nulls_first(), F.col("o_orderkey")], 5).select("type", "o_orderkey", F.round("rel_error", 6).alias("rel_error"), "place")


@query("""SELECT (SELECT count(*) FROM orders) AS gold, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing,
(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unknown""")
def alignment_integrity(spark, sf_dir):
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    pred = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    counts = pred.groupBy("k").agg(F.count("*").alias("n"))
    both = gold.withColumn("g", F.lit(1)).join(counts, "k", "full")
    return both.agg(F.count("g").alias("gold"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("g").isNull()).alias("unknown"))


@query("""SELECT o_orderkey, last.l_extendedprice AS last_price FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) last ON l_orderkey = o_orderkey""")
def last_prediction_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", order.alias("ordinal"))
    return J.align(orders, lines, "o_orderkey", "ordinal", strict=False).select("o_orderkey", F.col("pred.l_extendedprice").alias("last_price"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct, min(doc_id) AS least, max(doc_id) AS largest, max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AS contiguous FROM documents")
def id_integrity(spark, sf_dir):
    return J.integrity(table(spark, sf_dir, "documents"), "doc_id")


# Statistics of texts.


@query("""SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, """ + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM documents GROUP BY lang")
def length_quantiles(spark, sf_dir):
    return G.with_quantiles(table(spark, sf_dir, "documents"), "lang", "n_chars", G.LENGTH_POINTS, G.length_summary("n_chars"))


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, any_value(n) AS n, max(n_chars) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(n_chars) FILTER (i = floor(0.9 * (n - 1))) AS p90, max(n_chars) FILTER (i = floor(0.99 * (n - 1))) AS p99 FROM r GROUP BY lang""")
def floor_index_quantiles(spark, sf_dir):
    return G.floor_quantiles(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (l_discount >= {t}) AS ge_{str(t).replace('.', '_')}" for t in (0.0, 0.02, 0.05, 0.08)) + " FROM lineitem GROUP BY 1")
def threshold_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*G.at_least("l_discount", (0.0, 0.02, 0.05, 0.08)))


WORDS = r"[\p{L}\p{N}_]+"


@query(f"""WITH t AS (SELECT lang, text, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents)
SELECT lang, count(*) AS docs, sum(len(w))::BIGINT AS words, sum(len(list_distinct(w)))::BIGINT AS distinct_words, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
count(*) FILTER (text LIKE '%\\%%' ESCAPE '\\') AS has_percent, count(*) FILTER (regexp_matches(text, '\\d\\s*/\\s*\\d')) AS has_fraction, count(*) FILTER (regexp_matches(text, '-\\d')) AS has_negative, count(*) FILTER (text LIKE '%@%') AS has_at,
sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS digit_runs FROM t GROUP BY lang""")
def text_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flags = T.flags("text")
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.size(T.words("text"))).alias("words"), F.sum(F.size(T.words("text", distinct=True))).alias("distinct_words"), F.sum(F.size(F.split("text", "\n"))).alias("lines"),
        *(F.count_if(flags[k]).alias(k) for k in ("has_percent", "has_fraction", "has_negative")), F.count_if(F.col("text").contains("@")).alias("has_at"), F.sum(F.regexp_count("text", F.lit("[0-9]+"))).cast("long").alias("digit_runs"),
    )


@query("""SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'https' WHEN url LIKE 'http://%' THEN 'http' ELSE 'other' END AS scheme,
regexp_replace(lower(url), '[^a-z0-9_.-]+', '_', 'g') AS slug, regexp_matches(html, '<title>[^<]*[0-9]') AS numbered FROM pages""")
def page_slugs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.family("url", [("https", ["https://"]), ("http", ["http://"])]).alias("scheme"), T.slug(F.lower("url")).alias("slug"), F.col("html").rlike("<title>[^<]*[0-9]").alias("numbered"))


@query("""SELECT source, n, first FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source) ORDER BY n DESC, first LIMIT 10""")
def top_sources(spark, sf_dir):
    return G.histogram(table(spark, sf_dir, "documents"), "source", "doc_id", 10)


# Cleaning, dedup and splits.


@query("SELECT min(doc_id) AS doc_id, any_value(lang) AS lang FROM (SELECT doc_id, first(lang) OVER (PARTITION BY text ORDER BY doc_id) AS lang, trim(text) AS text FROM documents WHERE coalesce(trim(text), '') != '') GROUP BY text")
def clean_first_copies(spark, sf_dir):
    return P.clean_records(table(spark, sf_dir, "documents"), "text", None, "doc_id").select("doc_id", "lang")


@query("""WITH g AS (SELECT text, count(*) AS n, count(DISTINCT source) AS responses, count(DISTINCT lang) AS numbers FROM documents GROUP BY text HAVING count(*) > 1)
SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(n - 1), 0)::BIGINT AS extra, count(*) FILTER (responses <= 1) AS exact, count(*) FILTER (responses > 1 AND numbers <= 1) AS consistent, count(*) FILTER (numbers > 1) AS conflicting FROM g""")
def duplicate_groups(spark, sf_dir):
    return G.duplicate_groups(table(spark, sf_dir, "documents"), "text", "source", "lang")


@query("""SELECT size, count(*) AS groups FROM (SELECT source, count(DISTINCT text) AS size FROM documents GROUP BY source) GROUP BY size""")
def source_sizes(spark, sf_dir):
    return G.group_sizes(table(spark, sf_dir, "documents"), "source", "text")


FRACTION = "('0x' || substr(sha256({}), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT doc_id, {FRACTION.format("'split:' || doc_id")} < 0.1 AS held FROM documents")
def hash_split(spark, sf_dir):
    return P.hash_split(table(spark, sf_dir, "documents"), "doc_id", 0.1).select("doc_id", "held")


@query(f"""WITH k AS (SELECT DISTINCT source, doc_id, {FRACTION.format("'holdout:' || doc_id")} AS f FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f, doc_id) AS place, count(*) OVER (PARTITION BY source) AS size FROM k)
SELECT source, doc_id, place <= CASE WHEN size >= 2 THEN greatest(1, least(size - 1, round_even(size * 0.1, 0)::BIGINT)) ELSE 0 END AS held FROM r""")
def holdout_per_source(spark, sf_dir):
    return P.holdout_per_group(table(spark, sf_dir, "documents"), "source", "doc_id").select("source", "doc_id", "held")


@query(f"""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
m AS (SELECT source, lang AS bucket FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1),
r AS (SELECT source, row_number() OVER (PARTITION BY bucket ORDER BY {FRACTION.format("'group:' || source")}, source) <= greatest(1, round_even(count(*) OVER (PARTITION BY bucket) * 0.1, 0)::BIGINT) AS held FROM m)
SELECT held, count(*) AS docs, count(DISTINCT source) AS sources FROM documents JOIN r USING (source) GROUP BY held""")
def group_disjoint_split(spark, sf_dir):
    return P.group_disjoint_split(table(spark, sf_dir, "documents"), "source", "lang").groupBy("held").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))


@query(f"""SELECT conv_id, turn FROM conversations WHERE {FRACTION.format("conv_id::VARCHAR")} < 0.1""")
def calibration_rows(spark, sf_dir):
    return P.calibration_split(table(spark, sf_dir, "conversations"), "conv_id", 0.1).select("conv_id", "turn")


@query(f"""SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {FRACTION.format("'balanced:' || doc_id")}, doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 120""")
def balanced_subset(spark, sf_dir):
    return P.balanced_subset(table(spark, sf_dir, "documents"), "lang", "doc_id", 120).select("doc_id", "lang", "turn")


@query(f"SELECT doc_id FROM documents ORDER BY {FRACTION.format("'sample:' || doc_id")}, doc_id LIMIT 50")
def uniform_sample(spark, sf_dir):
    return P.sample(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id")


@query(f"""SELECT is_replay, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, false AS is_replay FROM documents UNION ALL SELECT doc_id, true FROM documents WHERE {FRACTION.format("'replay:' || doc_id")} < 0.25) GROUP BY 1""")
def replay_mix(spark, sf_dir):
    return P.replay(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25).groupBy("is_replay").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT o_orderkey, copy FROM (SELECT o_orderkey, unnest(range(1, 1 + least(3, (lines // 2))::BIGINT))::INT AS copy FROM (SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)) ORDER BY 1, 2 LIMIT 500""")
def capped_augmentation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")
    return P.augment(orders, "lines", "o_orderkey", 3, 500).select("o_orderkey", "copy")


@query("SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS total FROM events")
def running_clicks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("hit"))
    return P.running_total(events, "hit", "event_id", 4096).select("event_id", "total")


# Overlap and retrieval: benchmark items against documents.


def saved_index(spark: SparkSession, sf_dir: str, grams: Grams, jaccard: bool = False, max_df: float = 1.0, same: tuple[Column, ...] = ()) -> Retriever:
    """An index of all documents, saved in the shared folder."""
    rows = Retriever.rows(table(spark, sf_dir, "documents"), "doc_id", T.words("text"), same)
    return Retriever.fit(rows, scratch(spark, "index"), grams, jaccard, max_df)


def asked(index: Retriever, rows: DataFrame, row_id: str, k: int, same: tuple[Column, ...] = ()) -> DataFrame:
    return index.search(Retriever.rows(rows, row_id, T.words("text"), same), k)


@query("""WITH d AS (SELECT doc_id, lower(trim(text)) AS key, string_split(text, chr(10))[1] AS head FROM documents),
p AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT doc_id, key IN (SELECT key FROM d GROUP BY 1 HAVING count(*) > 1) AS copied, coalesce(head IN (SELECT head FROM d GROUP BY 1 HAVING count(DISTINCT key) > 1), false) AS shares_head FROM d
WHERE key IN (SELECT key FROM d GROUP BY 1 HAVING count(*) > 1) OR head IN (SELECT head FROM d GROUP BY 1 HAVING count(DISTINCT key) > 1) OR head IN (SELECT line FROM p)""")
def exact_overlap(spark, sf_dir):
    """Documents whose text another one has, or whose first line another text starts with or a conversation has as a line."""
    digest = lambda c: F.sha2(c, 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", digest(F.lower(F.trim("text"))).alias("key"), digest(F.get(F.split("text", "\n"), F.lit(0))).alias("head"))
    copies = docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 AND key IS NOT NULL")
    heads = docs.groupBy("head").agg(F.count_distinct("key").alias("n")).where("n > 1 AND head IS NOT NULL")
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line")).select(digest("line").alias("head"))
    found = J.union_all([J.seen_in(docs, copies, "key").select("doc_id", F.lit(1).alias("how")), J.seen_in(docs, heads, "head").select("doc_id", F.lit(2).alias("how")), J.seen_in(docs, lines, "head").select("doc_id", F.lit(4).alias("how"))])
    return found.groupBy("doc_id").agg((F.max(F.col("how") == 1)).alias("copied"), (F.max(F.col("how") == 2)).alias("shares_head"))


@query("""SELECT unnest(['shared', 'any', 'left_only']) AS keys, unnest([(SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)), (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)),
(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))]) AS n""")
def key_sets(spark, sf_dir):
    """Keys of customers and of orders: shared, of either, and customers without an order; held-out keys are disjoint."""
    orders, customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    split = P.hash_split(customers, "k", 0.1)
    J.require_disjoint(split.where("held"), split.where("not held"), "k")
    counts = [J.common_keys(orders, customers, "k"), J.all_keys([orders, customers], "k"), J.unseen_in(customers, orders, "k")]
    return J.union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("keys"), "n") for name, df in zip(("shared", "any", "left_only"), counts)])


OVERLAP_FIELDS = {"whole": "text", "first_line": "string_split(text, chr(10))[1]", "second_line": "string_split(text, chr(10))[2]", "source": "source"}
OVERLAP_NORMS = {"strip": "trim(x.k)", "space": "trim(regexp_replace(x.k, '[ \\t\\r\\n]+', ' ', 'g'))", "lower": "lower(trim(x.k))", "alnum": "regexp_replace(lower(x.k), '[^a-z0-9]+', '', 'g')"}


@query(f"""WITH d AS (SELECT doc_id, unnest([{", ".join(f"{{'f': '{n}', 'k': {e}}}" for n, e in OVERLAP_FIELDS.items())}]) AS x FROM documents),
a AS (SELECT doc_id, x.f AS field, unnest([{", ".join(f"{{'n': '{n}', 'k': {e}}}" for n, e in OVERLAP_NORMS.items())}]) AS y FROM d),
k AS (SELECT doc_id, field, y.n AS norm, y.k AS key FROM a WHERE y.k IS NOT NULL AND y.k != ''),
l AS (SELECT norm, field, key, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT norm, field, key, count(*) AS n, count(DISTINCT doc_id) AS m FROM k GROUP BY ALL)
SELECT l.norm, l.field AS left_field, r.field AS right_field, sum(r.m)::BIGINT AS n_rows, sum(l.n * r.n)::BIGINT AS n_pairs FROM l JOIN r ON l.norm = r.norm AND l.key = r.key GROUP BY 1, 2, 3""")
def overlap_matrix(spark, sf_dir):
    """All documents against all, four fields of either by four normal forms; a document meets itself in equal fields."""
    line = lambda i: F.get(F.split("text", "\n"), F.lit(i))
    norms = {"strip": F.trim, "space": lambda c: F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " ")), "lower": lambda c: F.lower(F.trim(c)), "alnum": lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")}
    fields = {"whole": F.col("text"), "first_line": line(0), "second_line": line(1), "source": F.col("source")}
    keys = J.unpivot_keys(table(spark, sf_dir, "documents"), "doc_id", fields, norms)
    return J.overlap_matrix(keys, keys, "doc_id", "doc_id")


@query(f"""WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM documents),
b AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM benchmark),
p AS (SELECT x.id AS item_id, i.id AS doc_id, count(*) AS shared FROM (SELECT id, unnest(w) AS token FROM b) x JOIN (SELECT id, unnest(w) AS token FROM t) i USING (token) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, shared / (len(b.w) + len(t.w) - shared) AS j FROM p JOIN b ON b.id = item_id JOIN t ON t.id = doc_id)
SELECT item_id, doc_id, round(j, 6) AS jaccard, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS place FROM s) WHERE place <= 3""")
def nearest_by_jaccard(spark, sf_dir):
    """The three documents nearest to each item by their sets of words, exactly."""
    got = asked(saved_index(spark, sf_dir, Grams(), jaccard=True), table(spark, sf_dir, "benchmark"), "item_id", 3)
    return got.select(F.col("query_id").alias("item_id"), F.col("index_id").alias("doc_id"), F.round("similarity", 6).alias("jaccard"), "place")


@query(f"""WITH t AS (SELECT doc_id AS id, source, lang, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM documents),
x AS (SELECT id, unnest(w) AS token FROM t), p AS (SELECT q.id AS query_id, i.id AS index_id, count(*) AS shared FROM x q JOIN x i USING (token) WHERE q.id % 20 = 0 GROUP BY 1, 2),
s AS (SELECT query_id, index_id, round(shared / (len(a.w) + len(b.w) - shared), 9) AS j, coalesce(a.source = b.source, a.source IS NULL AND b.source IS NULL)::INT AS s1, coalesce(a.lang = b.lang, a.lang IS NULL AND b.lang IS NULL)::INT AS s2 FROM p JOIN t a ON a.id = query_id JOIN t b ON b.id = index_id)
SELECT query_id, index_id, round(j, 6) AS jaccard, s1 = 1 AS same_source, s2 = 1 AS same_lang, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, s1 DESC, s2 DESC, index_id) AS place FROM s) WHERE place <= 12""")
def similar_documents(spark, sf_dir):
    """The twelve documents most similar to every twentieth one; of equal similarity first those of its source, then of its language."""
    docs = table(spark, sf_dir, "documents")
    same = (F.col("source"), F.col("lang"))
    got = asked(saved_index(spark, sf_dir, Grams(), jaccard=True, same=same), docs.where("doc_id % 20 = 0"), "doc_id", 12, same)
    return got.select("query_id", "index_id", F.round("similarity", 6).alias("jaccard"), (F.col("same").bitwiseAND(2) > 0).alias("same_source"), (F.col("same").bitwiseAND(1) > 0).alias("same_lang"), "place")


@query("""WITH p AS (SELECT l_orderkey, round(l_extendedprice, 2) AS price FROM lineitem), o AS (SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderpriority FROM orders),
g AS (SELECT l_orderkey, list(DISTINCT price) AS prices FROM p GROUP BY 1)
SELECT o_orderpriority, CASE WHEN g.l_orderkey IS NULL THEN 'unseen' WHEN o.price IS NULL THEN 'missing' WHEN list_contains(prices, o.price) THEN 'same' ELSE 'conflict' END AS overlap, count(*) AS n FROM o LEFT JOIN g ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def overlap_classes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.round("l_extendedprice", 2).alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("price"), "o_orderpriority")
    return G.overlap_class(orders, lines, "k", "price").groupBy("o_orderpriority", "overlap").agg(F.count("*").alias("n"))


# Votes: each line item votes for a return flag of its part.


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, seen, l_returnflag) AS p, sum(n) OVER (PARTITION BY l_partkey) AS votes, count(*) OVER (PARTITION BY l_partkey) AS u FROM c)
SELECT l_partkey, max(l_returnflag) FILTER (p = 1) AS top_answer, any_value(votes)::BIGINT AS votes, any_value(u) AS n_unique, max(n) FILTER (p = 1) AS top_n, round(max(n) FILTER (p = 1) / any_value(votes), 6) AS frac,
round((max(n) FILTER (p = 1) - coalesce(max(n) FILTER (p > 1), 0)) / any_value(votes), 6) AS margin FROM r GROUP BY l_partkey""")
def majority_vote(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    got = V.majority(lines, "l_partkey", "l_returnflag", "ordinal")
    return got.select("l_partkey", "top_answer", "votes", "n_unique", "top_n", F.round("frac", 6).alias("frac"), F.round("margin", 6).alias("margin"))


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority) AS over_all FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, o_orderstatus)))
SELECT o_orderpriority, o_orderstatus, n, over_all::TINYINT AS over_all, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY over_all, o_orderpriority)), 6) AS prior_norm FROM c""")
def answer_priors(spark, sf_dir):
    return V.priors(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select("o_orderpriority", "o_orderstatus", "n", "over_all", F.round("prior_norm", 6).alias("prior_norm"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS votes, max(event_id) AS priority FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS chosen, votes, priority FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, priority DESC, event_type DESC) = 1""")
def consensus_vote(spark, sf_dir):
    return V.consensus(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT user_id, event_id, event_type, round_even(value, 0) AS v FROM events), c AS (SELECT user_id, v, count(*) AS n, min(event_id) AS first FROM v GROUP BY 1, 2),
b AS (SELECT user_id, first FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN v IS NULL THEN 0 ELSE -n END, first) = 1)
SELECT b.user_id, event_type AS chosen FROM b JOIN events e ON e.event_id = b.first""")
def first_of_mode(spark, sf_dir):
    return V.first_of_mode(table(spark, sf_dir, "events"), "user_id", "value", "event_type", "event_id", digits=0)


# Runs: quality scores of each order's line items, a run a line number.

RUNS_SQL = """WITH runs AS (SELECT l_orderkey AS id, 'r' || l_linenumber AS run, CASE WHEN l_discount <= 0.01 THEN 10 WHEN l_discount <= 0.03 THEN 5 WHEN l_discount <= 0.06 THEN 1 ELSE 0 END AS score, l_returnflag AS kind FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    score = F.when(d <= 0.01, 10).when(d <= 0.03, 5).when(d <= 0.06, 1).otherwise(0)
    lines = table(spark, sf_dir, "lineitem")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")).alias("m"))
    one = one.select("l_orderkey", "l_linenumber", "m.l_discount", "m.l_returnflag")
    return one.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("run"), score.alias("score"), F.col("l_returnflag").alias("kind"))


@query(RUNS_SQL + "SELECT count(*) AS n, sum(best)::BIGINT AS raw, count(*) FILTER (best = 0) AS zero_in_all, count(*) FILTER (d = 1) AS all_equal FROM (SELECT id, max(score) AS best, count(DISTINCT score) AS d FROM runs GROUP BY id)")
def oracle_ensemble(spark, sf_dir):
    return G.oracle_summary(runs(spark, sf_dir), "run", "id", "score")


@query(RUNS_SQL + "SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, count(*) FILTER (b.score > a.score) AS better, count(*) FILTER (b.score < a.score) AS worse, count(*) FILTER (b.score = a.score) AS same, sum(b.score - a.score)::BIGINT AS delta FROM runs a JOIN runs b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2")
def run_pairs(spark, sf_dir):
    return J.pair_runs(runs(spark, sf_dir), "run", "id", "score")


@query(RUNS_SQL + """, p AS (SELECT a.kind, a.score AS before, b.score AS after FROM runs a JOIN runs b ON a.id = b.id AND a.run = 'r1' AND b.run = 'r2')
SELECT kind, before, after, count(*) AS n, grouping(kind)::TINYINT AS over_all FROM p GROUP BY GROUPING SETS ((kind, before, after), (before, after))""")
def score_transitions(spark, sf_dir):
    r = runs(spark, sf_dir)
    pairs = r.where("run = 'r1'").select("id", "kind", F.col("score").alias("before")).join(r.where("run = 'r2'").select("id", F.col("score").alias("after")), "id")
    return G.transitions(pairs, "kind", "before", "after")


@query(RUNS_SQL + "SELECT kind, run, round(avg(score), 6) AS mean, count(score) AS n, round(any_value(item_mean), 6) AS item_mean FROM runs JOIN (SELECT run, avg(score) AS item_mean FROM runs GROUP BY run) USING (run) GROUP BY kind, run")
def fallback_means(spark, sf_dir):
    got = G.hierarchical_means(runs(spark, sf_dir), "kind", "run", "score")
    return got.select("kind", "run", F.round("mean", 6).alias("mean"), "n", F.round("item_mean", 6).alias("item_mean"))


@query(RUNS_SQL + """SELECT run, count(*) AS n, sum(score)::BIGINT AS raw, count(*) FILTER (score = 10) AS tens FROM runs GROUP BY run ORDER BY raw DESC, tens DESC, run LIMIT 1""")
def best_run(spark, sf_dir):
    summary = runs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.sum("score").alias("raw"), F.count_if(F.col("score") == 10).alias("tens"))
    return H.select_best(summary, [F.desc("raw"), F.desc("tens"), F.col("run")])


@query(RUNS_SQL + """SELECT kind, sum(a.score)::BIGINT AS base_raw, sum(b.score)::BIGINT AS expert_raw, sum(b.score) > sum(a.score) AS routed FROM (SELECT * FROM runs WHERE run = 'r1') a JOIN (SELECT id, score FROM runs WHERE run = 'r2') b USING (id) GROUP BY kind""")
def expert_routing(spark, sf_dir):
    r = runs(spark, sf_dir)
    return H.route(r.where("run = 'r1'"), r.where("run = 'r2'"), "kind", "id", "score")


@query(RUNS_SQL + """, b AS (SELECT * FROM runs WHERE run = 'r1'), o AS (SELECT id, score FROM runs WHERE run = 'r3')
SELECT b.id, CASE WHEN o.id IS NOT NULL AND kind = 'R' THEN 'over' ELSE 'base' END AS origin, CASE WHEN o.id IS NOT NULL AND kind = 'R' THEN o.score ELSE b.score END AS score FROM b LEFT JOIN o ON o.id = b.id""")
def overlay_routed(spark, sf_dir):
    r = runs(spark, sf_dir)
    return J.overlay(r.where("run = 'r1'"), r.where("run = 'r3'"), "id", "score", F.col("kind") == "R").select("id", "origin", "score")


@query("""SELECT o_orderkey AS k, coalesce(a.v, b.v) AS v FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = o_orderkey LEFT JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus != 'P') b ON b.k = o_orderkey""")
def solver_fallback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    solver = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    other = orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return J.coalesce_sources(orders.select(F.col("o_orderkey").alias("k")), [solver, other], "k", "v")


GATE = """, x AS (SELECT kind, a.score AS base, b.score AS gated, sim FROM (SELECT * FROM runs WHERE run = 'r1') a JOIN (SELECT id, score FROM runs WHERE run = 'r2') b USING (id) JOIN (SELECT l_orderkey AS id, avg(l_quantity) / 50 AS sim FROM lineitem GROUP BY 1) s USING (id))
"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    sim = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.avg("l_quantity") / 50).alias("sim"))
    return r.where("run = 'r1'").select("id", "kind", F.col("score").alias("base")).join(r.where("run = 'r2'").select("id", F.col("score").alias("gated")), "id").join(sim, "id")


@query(RUNS_SQL + GATE + """, c AS (SELECT * FROM (VALUES (0, 0.3, 0.0), (1, 0.3, 5.0), (2, 0.5, 0.0), (3, 0.5, 5.0), (4, 0.7, 0.0), (5, 0.7, 5.0)) t(config, least_sim, least_gated)),
e AS (SELECT kind, config, sum(CASE WHEN p THEN gated ELSE base END) AS raw, count(*) FILTER (CASE WHEN p THEN gated ELSE base END = 10) AS tens, count(*) FILTER (CASE WHEN p THEN gated ELSE base END = 0) AS zeros, count(*) FILTER (p) AS used, sum(base) AS base_raw, count(*) AS n FROM (SELECT *, sim >= least_sim AND gated >= least_gated AS p FROM x, c) GROUP BY 1, 2)
SELECT kind, config, raw::BIGINT AS raw, base_raw::BIGINT AS base_raw, used, n, raw > base_raw AS enabled FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY raw DESC, tens DESC, zeros, used, config) = 1""")
def gate_sweep(spark, sf_dir):
    configs = H.grid(least_sim=[0.3, 0.5, 0.7], least_gated=[0.0, 5.0])
    return H.sweep(gated(spark, sf_dir), configs, "kind", lambda c: (F.col("sim") >= c["least_sim"]) & (F.col("gated") >= c["least_gated"]), "gated", "base")


@query("""SELECT user_id, """ + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM events WHERE value IS NOT NULL GROUP BY user_id")
def selected_quantiles(spark, sf_dir):
    """Exact quantiles of every user's values by counting bins, whatever the size of a group."""
    return G.quantiles(table(spark, sf_dir, "events"), "user_id", "value", G.LENGTH_POINTS)


GRID = {"sim": [0.4, 0.5, 0.6, 0.7], "gated": [0.0, 1.0, 5.0, 10.0], "least": [0.02, 0.1, 0.2, 0.4]}


@query(RUNS_SQL + GATE.replace("SELECT kind,", "SELECT id, kind,", 1) + f""", y AS (SELECT x.*, least FROM x JOIN (SELECT l_orderkey AS id, min(l_quantity) / 50 AS least FROM lineitem GROUP BY 1) USING (id)),
c AS (SELECT row_number() OVER () - 1 AS config, a, b, d FROM (SELECT unnest({GRID["sim"]}) AS a) CROSS JOIN (SELECT unnest({GRID["gated"]}) AS b) CROSS JOIN (SELECT unnest({GRID["least"]}) AS d)),
o AS (SELECT a, b, d, row_number() OVER (ORDER BY a, b, d) - 1 AS config FROM c),
e AS (SELECT kind, config, sum(CASE WHEN p THEN gated ELSE base END) AS raw, count(*) FILTER (CASE WHEN p THEN gated ELSE base END = 10) AS tens, count(*) FILTER (CASE WHEN p THEN gated ELSE base END = 0) AS zeros, count(*) FILTER (p) AS used, sum(base) AS base_raw, count(*) AS n FROM (SELECT *, sim >= a AND gated >= b AND least >= d AS p FROM y, o) GROUP BY 1, 2)
SELECT kind, config, raw::BIGINT AS raw, base_raw::BIGINT AS base_raw, used, n, raw > base_raw AS enabled FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY raw DESC, tens DESC, zeros, used, config) = 1""")
def grid_sweep(spark, sf_dir):
    """The whole grid of four limits on each of three columns, for each kind, from sums of cells."""
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.min("l_quantity") / 50).alias("least"))
    return H.grid_sweep(gated(spark, sf_dir).join(least, "id"), GRID, "kind", "gated", "base")


@query(RUNS_SQL + GATE + """SELECT threshold, count(*) FILTER (sim >= threshold) AS used, sum(CASE WHEN sim >= threshold THEN gated ELSE base END)::BIGINT AS raw FROM x, (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8])::DOUBLE AS threshold) GROUP BY 1""")
def threshold_replay(spark, sf_dir):
    return H.threshold_replay(gated(spark, sf_dir), [0.2, 0.4, 0.5, 0.6, 0.8], "sim", "gated", "base")


@query(RUNS_SQL + GATE + """SELECT CASE WHEN kind = 'N' THEN 'type_not_allowed' WHEN sim < 0.3 THEN 'low_similarity' WHEN gated < base THEN 'low_confidence' ELSE 'used' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def gate_reasons(spark, sf_dir):
    reason = H.gate_reason([("type_not_allowed", F.col("kind") != "N"), ("low_similarity", F.col("sim") >= 0.3), ("low_confidence", F.col("gated") >= F.col("base"))])
    return gated(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT slice, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM (SELECT unnest(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 2000 THEN 'long' END, 'all'], lambda x: x IS NOT NULL)) AS slice, quality, toxic FROM labels JOIN documents USING (doc_id)) GROUP BY slice""")
def overlapping_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    named = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 2000, "all": F.lit(True)}
    return G.slices(rows, named, [F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")])


@query("""SELECT o_orderkey, o_custkey, advantage FROM (SELECT o_orderkey, o_custkey, round(year(o_orderdate) - avg(year(o_orderdate)) OVER (PARTITION BY o_custkey), 6) AS advantage FROM orders)""")
def group_advantage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("double").alias("y"))
    return G.advantage(orders, "y", "o_custkey").select("o_orderkey", "o_custkey", F.round("advantage", 6).alias("advantage"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS p FROM events) WHERE p <= 50 GROUP BY 1""")
def tail_means(spark, sf_dir):
    return G.tail_mean(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", "n", F.round("mean", 4).alias("mean"))


@query("""SELECT array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def json_fields(spark, sf_dir):
    keys = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return table(spark, sf_dir, "events").groupBy(keys.alias("fields")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT u.conv_id, u.turn, u.turn + 1 AS reply_turn, length(a.text) AS reply_chars FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def question_answer_pairs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead(F.struct("turn", "role", F.length("text").alias("n"))).over(w).alias("next"))
    return rows.where((F.col("role") == "user") & (F.col("next.role") == "assistant") & (F.col("next.turn") == F.col("turn") + 1)).select("conv_id", "turn", F.col("next.turn").alias("reply_turn"), F.col("next.n").alias("reply_chars"))


@query(r"""SELECT o_orderkey, a AS answer, anchor, a::DOUBLE AS num, regexp_replace(a, '\.0$', '') AS key, CASE WHEN a IS NULL THEN 'missing' WHEN contains(a, '.') THEN 'decimal_dot' ELSE 'integer' END AS form FROM (
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN printf('%.2f', floor(o_totalprice) + 0.25) WHEN 3 THEN NULL ELSE o_custkey::VARCHAR END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'dap_an_la' WHEN 1 THEN 'hash4' WHEN 2 THEN 'boxed' END AS anchor FROM orders)""")
def reply_answers(spark, sf_dir):
    """Answers and numbers in replies that name an order's price or customer behind an anchor, in a box, or not at all."""
    k, price, customer = F.col("o_orderkey") % 4, F.format_string("%.2f", F.floor("o_totalprice") + 0.25), F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Ta tính #### 1\nĐáp án là: "), price, F.lit("."))).when(k == 1, F.concat(F.lit("Đáp án là: 5\n#### "), customer)).when(k == 2, F.concat(F.lit("Vậy \\boxed{"), customer, F.lit("} là số khách"))).otherwise("không có")
    got = table(spark, sf_dir, "orders").select("o_orderkey", A.extracted(text).alias("a"))
    return got.select("o_orderkey", "a.answer", "a.anchor", "a.num", A.keyed("a.num").alias("key"), A.answer_form("a.answer", "a.num").alias("form"))


# Retrieval, candidates and templates.

GRAMS_SQL = f"""list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents), b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM benchmark),
dt AS (SELECT id, unnest({GRAMS_SQL}) AS term FROM d), dc AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY 1, 2), bt AS (SELECT id, unnest({GRAMS_SQL}) AS term FROM b), bc AS (SELECT id, term, count(*) AS tf FROM bt GROUP BY 1, 2),
n AS (SELECT count(DISTINCT id) AS n FROM dc), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM dc, n GROUP BY term, n HAVING count(*) <= n * 0.35),
dx AS (SELECT id, term, tf * idf AS x FROM dc JOIN idf USING (term)), dw AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM dx),
bx AS (SELECT id, term, tf * idf AS x FROM bc JOIN idf USING (term)), bw AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM bx),
s AS (SELECT bw.id AS query_id, dw.id AS index_id, sum(bw.w * dw.w) AS sim FROM bw JOIN dw USING (term) GROUP BY 1, 2)
SELECT query_id, index_id, round(sim, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, index_id) AS place FROM s) WHERE place <= 5""")
def tfidf_neighbours(spark, sf_dir):
    got = asked(saved_index(spark, sf_dir, Grams((1, 2)), max_df=0.35), table(spark, sf_dir, "benchmark"), "item_id", 5)
    return got.select("query_id", "index_id", F.round("similarity", 6).alias("similarity"), "place")


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents),
b AS (SELECT 'item' AS asked, item_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM benchmark UNION ALL SELECT 'first turn', conv_id, regexp_extract_all(lower(text), '{WORDS}') FROM conversations WHERE turn = 0),
dc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({GRAMS_SQL}) AS term FROM d) GROUP BY 1, 2), bc AS (SELECT asked, id, term, count(*) AS tf FROM (SELECT asked, id, unnest({GRAMS_SQL}) AS term FROM b) GROUP BY 1, 2, 3),
n AS (SELECT count(DISTINCT id) AS n FROM dc), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM dc, n GROUP BY term, n HAVING count(*) <= n * 0.35),
dx AS (SELECT id, term, tf * idf AS x FROM dc JOIN idf USING (term)), dw AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM dx),
bx AS (SELECT asked, id, term, tf * idf AS x FROM bc JOIN idf USING (term)), bw AS (SELECT asked, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY asked, id)) AS w FROM bx),
s AS (SELECT asked, bw.id AS query_id, dw.id AS index_id, sum(bw.w * dw.w) AS sim FROM bw JOIN dw USING (term) GROUP BY 1, 2, 3)
SELECT asked, query_id, index_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY asked, query_id ORDER BY round(sim, 9) DESC, index_id) AS place FROM s) WHERE place = 1""")
def one_index_two_query_sets(spark, sf_dir):
    """The nearest document of each benchmark item and of each conversation's first turn, asked of one saved index."""
    index = saved_index(spark, sf_dir, Grams((1, 2)), max_df=0.35)
    again = Retriever(spark, index.path, index.grams, index.jaccard)
    sets = {"item": (table(spark, sf_dir, "benchmark"), "item_id"), "first turn": (table(spark, sf_dir, "conversations").where("turn = 0"), "conv_id")}
    return J.union_all([asked(again, rows, row, 1).select(F.lit(name).alias("asked"), "query_id", "index_id", F.round("similarity", 6).alias("similarity")) for name, (rows, row) in sets.items()])


#: Grams of three to five characters inside each blank-padded word; a padded word that is shorter counts once.
CHAR_GRAMS_SQL = "flatten(list_transform(w, lambda v: list_concat(CASE WHEN length(v) < 1 THEN [' ' || v || ' '] ELSE [] END, flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(v) + 4 - n), lambda i: substr(' ' || v || ' ', i::BIGINT, n::BIGINT)))))))"


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents), b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM benchmark),
dc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({CHAR_GRAMS_SQL}) AS term FROM d) GROUP BY 1, 2), bc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({CHAR_GRAMS_SQL}) AS term FROM b) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT id) AS n FROM dc), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM dc, n GROUP BY term, n),
dx AS (SELECT id, term, tf * idf AS x FROM dc JOIN idf USING (term)), dn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM dx GROUP BY id), bx AS (SELECT id, term, tf * idf AS x FROM bc JOIN idf USING (term)), bn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM bx GROUP BY id),
s AS (SELECT bx.id AS query_id, dx.id AS index_id, sum(bx.x / bn.norm * (dx.x / dn.norm)) AS sim FROM bx JOIN bn ON bn.id = bx.id JOIN dx USING (term) JOIN dn ON dn.id = dx.id GROUP BY 1, 2)
SELECT query_id, index_id, round(sim, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, index_id) AS place FROM s) WHERE place <= 9""")
def char_gram_neighbours(spark, sf_dir):
    """Character n-gram retrieval of documents, by their whole texts, for benchmark items."""
    got = asked(saved_index(spark, sf_dir, Grams((3, 4, 5), characters=True)), table(spark, sf_dir, "benchmark"), "item_id", 9)
    return got.select("query_id", "index_id", F.round("similarity", 6).alias("similarity"), "place")


CANDIDATES_SQL = """WITH h AS (SELECT l_orderkey AS row, l_shipmode AS key, l_discount * 10 AS similarity, l_tax * 10 AS jaccard FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
g AS (SELECT row, key, count(*) AS retrieval_count, max(similarity) AS top_sim, max(jaccard) AS top_jaccard FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rank, retrieval_count / sum(retrieval_count) OVER (PARTITION BY row) AS frac, (retrieval_count - coalesce(lead(retrieval_count) OVER w, 0)) / sum(retrieval_count) OVER (PARTITION BY row) AS lead FROM g WINDOW w AS (PARTITION BY row ORDER BY retrieval_count DESC, top_sim DESC, top_jaccard DESC, key)),
a AS (SELECT row, key, retrieval_count, top_sim, top_jaccard, rank, frac, CASE WHEN rank = 1 THEN lead ELSE 0.0 END AS margin FROM r)
"""


def hit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("key"), (F.col("l_discount") * 10).alias("similarity"), (F.col("l_tax") * 10).alias("jaccard"))
    return V.answer_groups(hits, "row", "key")


@query(CANDIDATES_SQL + """SELECT row, key, retrieval_count, rank, round(frac, 6) AS frac, round(margin, 6) AS margin, round(least(1.0, 0.5 * top_sim + 0.18 * top_jaccard + 0.18 * frac + 0.1 * margin + CASE WHEN key = 'NO' THEN 0.12 ELSE 0 END), 6) AS confidence FROM a""")
def answer_group_confidence(spark, sf_dir):
    got = hit_groups(spark, sf_dir)
    conf = V.group_confidence(F.col("key") == "NO", F.lit(False))
    return got.select("row", "key", "retrieval_count", "rank", F.round("frac", 6).alias("frac"), F.round("margin", 6).alias("margin"), F.round(conf, 6).alias("confidence"))


MODEL_SQL = """, m AS (SELECT o_orderkey AS row, CASE WHEN o_orderstatus = 'O' THEN 'NO' WHEN o_orderstatus = 'F' THEN 'RF' ELSE 'AF' END AS key, 2 AS model_votes, 0.5::DOUBLE AS model_frac FROM orders)
"""


@query(CANDIDATES_SQL + MODEL_SQL + """, c AS (SELECT coalesce(m.row, a.row) AS row, coalesce(m.key, a.key) AS key, coalesce(model_votes, 0) AS votes, coalesce(model_frac, 0) AS f, coalesce(retrieval_count, 0) AS n, coalesce(top_sim, 0) AS s, coalesce(top_jaccard, 0) AS j FROM m FULL JOIN a ON m.row = a.row AND m.key = a.key),
x AS (SELECT *, s >= 0.7 AND j >= 0.45 AND n > 0 AS gate FROM c)
SELECT row, key AS chosen, round(f + CASE WHEN gate THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN gate AND votes > 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM x
QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(f + CASE WHEN gate THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN gate AND votes > 0 THEN 0.2::DOUBLE ELSE 0 END, 6) DESC, votes DESC, n DESC, key DESC) = 1""")
def candidate_ranking(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "NO").when(F.col("o_orderstatus") == "F", "RF").otherwise("AF")
    model = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), status.alias("key"), F.lit(2).alias("model_votes"), F.lit(0.5).alias("model_frac"))
    both = V.model_and_retrieval(model, hit_groups(spark, sf_dir), "row", "key").withColumns({"prior_norm": F.lit(0.0), "sanity_penalty": F.lit(0.0)})
    score = F.round(V.linear_rank_score({"vote": 1.0, "bonus": 0.3, "agree": 0.2}), 6)
    return V.pick(both, "row", "key", score, [F.col("model_votes"), F.col("retrieval_count")])


@query("""WITH c AS (SELECT l_orderkey AS row, l_returnflag AS key, 'flag' AS source, l_discount AS confidence FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, 'status', l_tax FROM lineitem UNION ALL SELECT o_orderkey, o_orderstatus, 'order', 0.05 FROM orders)
SELECT row, key, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM c GROUP BY 1, 2""")
def merged_candidates(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    make = lambda df, row, key, source, conf: df.select(F.col(row).alias("row"), F.col(key).alias("key"), F.lit(source).alias("source"), conf.alias("confidence"))
    frames = [make(lines, "l_orderkey", "l_returnflag", "flag", F.col("l_discount")), make(lines, "l_orderkey", "l_linestatus", "status", F.col("l_tax")), make(orders, "o_orderkey", "o_orderstatus", "order", F.lit(0.05))]
    return V.merge_candidates(frames, "row", "key").withColumn("sources", F.array_join("sources", ","))


SELECTED_SQL = CANDIDATES_SQL + """, m AS (SELECT o_orderkey AS row, CASE WHEN o_orderstatus = 'O' THEN 'NO' WHEN o_orderstatus = 'F' THEN 'RF' ELSE 'AF' END AS key, 2 AS model_votes, 0.5::DOUBLE AS model_frac, (o_custkey % 3)::DOUBLE AS model_priority FROM orders WHERE o_custkey % 5 > 0),
pr AS (SELECT l_returnflag || l_linestatus AS key, count(*) AS prior FROM lineitem GROUP BY 1), pn AS (SELECT key, prior, ln(1 + prior) / ln(1 + max(prior) OVER ()) AS prior_norm FROM pr),
c AS (SELECT coalesce(m.row, a.row) AS row, coalesce(m.key, a.key) AS key, coalesce(model_votes, 0) AS votes, coalesce(model_frac, 0) AS f, coalesce(model_priority, 0) AS pri, coalesce(top_sim, 0) AS s, coalesce(top_jaccard, 0) AS j, coalesce(frac, 0) AS fr, coalesce(margin, 0) AS mg FROM m FULL JOIN a ON m.row = a.row AND m.key = a.key),
x AS (SELECT c.*, coalesce(prior, 0) AS prior, coalesce(prior_norm, 0) AS pn, s >= 0.6 AND j >= 0.3 AND fr >= 0.5 AND mg >= 0.2 AS ok FROM c LEFT JOIN pn USING (key)),
y AS (SELECT *, round(f + 0.1::DOUBLE * pn + 0.001::DOUBLE * pri + CASE WHEN ok THEN 0.3::DOUBLE + 0.20::DOUBLE * fr + 0.10::DOUBLE * mg ELSE 0.0 END, 9) AS score FROM x WHERE votes > 0 OR ok)
SELECT row, key AS chosen, round(score, 6) AS score FROM y QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, votes > 0 DESC, ok DESC, votes DESC, prior DESC, key DESC) = 1"""


@query(SELECTED_SQL)
def selected_candidates(spark, sf_dir):
    """Model and retrieval candidates by the six-part rank; retrieval alone counts where its four limits are passed."""
    status = F.col("o_orderstatus")
    model = table(spark, sf_dir, "orders").where("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("row"), F.when(status == "O", "NO").when(status == "F", "RF").otherwise("AF").alias("key"), F.lit(2).alias("model_votes"), F.lit(0.5).alias("model_frac"), (F.col("o_custkey") % 3).cast("double").alias("model_priority"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("prior"))
    priors = lines.withColumn("prior_norm", F.log1p("prior") / F.log1p(F.max("prior").over(W.partitionBy())))  # of a row a key
    both = V.model_and_retrieval(model, hit_groups(spark, sf_dir), "row", "key").join(priors, F.col("key") == F.col("k"), "left").fillna(0, ["prior", "prior_norm"])
    got = V.select_candidates(both, "row", "key", {"prior": 0.1, "bonus": 0.3, "retrieval_only": True, "least_sim": 0.6, "least_jaccard": 0.3, "least_frac": 0.5, "least_margin": 0.2})
    return got.select("row", "chosen", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT p_partkey AS row, CASE p_size % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' WHEN 3 THEN 'O' ELSE 'X' END AS kind, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey END AS g, ['q' || (p_size % 5), 's' || (p_size % 3)] AS t, CASE WHEN p_size % 9 > 0 THEN (p_size % 8)::DOUBLE END AS model FROM part),
e AS (SELECT l_partkey AS g, l_returnflag AS kind, l_linenumber::DOUBLE AS n, ['q' || (l_quantity::INT % 5), 's' || (l_suppkey % 3)] AS t FROM lineitem WHERE l_quantity > 40),
p AS (SELECT row, e.kind = q.kind AS typed, n, count(*) AS c, max(len(list_intersect(q.t, e.t)) / (4 - len(list_intersect(q.t, e.t)))) AS j FROM q JOIN e USING (g) GROUP BY ALL),
s AS (SELECT row, count(*) AS groups, sum(c) AS n_rows, bool_or(typed) AS typed FROM p GROUP BY 1),
w AS (SELECT p.*, sum(c) OVER (PARTITION BY row) AS pool, row_number() OVER (PARTITION BY row ORDER BY c DESC, j DESC, abs(n), n DESC) AS place FROM p JOIN s USING (row) WHERE p.typed = s.typed),
b AS (SELECT a.row, a.n, a.pool, a.c / a.pool AS frac, (a.c - coalesce(z.c, 0)) / a.pool AS margin, a.j FROM w a LEFT JOIN w z ON z.row = a.row AND z.place = 2 WHERE a.place = 1),
f AS (SELECT q.row, q.kind, q.model, coalesce(n_rows, 0) AS n_rows, coalesce(typed, false) AS typed, b.*, coalesce(abs(q.model - b.n) <= 1e-9 * greatest(1.0, abs(q.model), abs(b.n)), false) AS agrees FROM q LEFT JOIN s USING (row) LEFT JOIN b USING (row)),
d AS (SELECT *, coalesce(frac >= CASE WHEN kind = 'A' THEN 0.2 ELSE 0.34 END AND margin >= 0.1 AND j >= 0.3, false) OR (kind = 'N' AND agrees) AS passed FROM f),
r AS (SELECT *, CASE WHEN kind = 'R' THEN 'type_gate_disabled' WHEN kind = 'X' THEN 'type_not_allowed' WHEN n_rows < 2 THEN 'source_unseen' WHEN kind = 'A' AND NOT typed THEN 'typed_pool_missing' WHEN NOT passed AND model IS NOT NULL AND NOT agrees THEN 'low_confidence_model_disagree' WHEN NOT passed THEN 'low_confidence' ELSE 'used' END AS reason FROM d)
SELECT row, reason, CASE WHEN reason = 'used' THEN n END AS chosen, pool::BIGINT AS pool, round(frac, 6) AS frac, round(margin, 6) AS margin, round(j, 6) AS nearest FROM r""")
def gated_retrieval(spark, sf_dir):
    """Parts ask the line items of their number for one; all reasons of the gate, typed pools, and models that agree."""
    size, words = F.col("p_size"), lambda q, s: F.array(F.concat(F.lit("q"), (q % 5).cast("string")), F.concat(F.lit("s"), (s % 3).cast("string")))
    kind = F.when(size % 5 == 0, "A").when(size % 5 == 1, "N").when(size % 5 == 2, "R").when(size % 5 == 3, "O").otherwise("X")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), kind.alias("kind"), F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_partkey")).alias("g"), words(size, size).alias("t"), F.when(size % 9 > 0, (size % 8).cast("double")).alias("model"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("g"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("n"), words(F.col("l_quantity").cast("int"), F.col("l_suppkey")).alias("t"))
    by_kind = {"R": {"enabled": False}, "A": {"require_typed_pool": True, "least_frac": 0.2}, "N": {"agreement_bypass": True}}
    got = H.gated_retrieval(parts, lines, "row", "kind", "g", "t", "n", "model", {"least_frac": 0.34, "least_margin": 0.1, "least_jaccard": 0.3}, by_kind, ["A", "N", "R", "O"], 2)
    return got.select("row", "reason", "chosen", "pool", *(F.round(c, 6).alias(c) for c in ("frac", "margin", "nearest")))


@query("""WITH h AS (SELECT l_orderkey AS row, l_returnflag || l_linestatus AS key, l_quantity / 50 AS s, l_discount * 10 AS j, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS o FROM lineitem WHERE l_tax > 0.01),
pr AS (SELECT key, count(*) AS prior FROM h GROUP BY 1), g AS (SELECT row, key, count(*) AS n, max(s) AS s, max(j) AS j, max(prior) AS p, min(o) AS o FROM h JOIN pr USING (key) GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY row) AS hits, row_number() OVER w AS place, lead(n, 1, 0) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY row ORDER BY n DESC, s DESC, j DESC, p DESC, o, key)),
q AS (SELECT o_orderkey AS row, CASE WHEN o_orderstatus = 'O' THEN 'NO' WHEN o_orderstatus = 'F' THEN 'RF' END AS model FROM orders),
d AS (SELECT q.row, model, key, hits, n / hits AS frac, (n - nxt) / hits AS margin, s >= 0.5 AND j >= 0.2 AND n / hits >= 0.5 AND (n - nxt) / hits >= 0.25 AS ok FROM q LEFT JOIN (SELECT * FROM r WHERE place = 1) b USING (row)),
f AS (SELECT *, unnest(['missing_only', 'override', 'agree_only']) AS form FROM d),
e AS (SELECT *, CASE WHEN hits IS NULL THEN 'no_hits' WHEN ok THEN 'passed' ELSE 'low_confidence' END AS reason FROM f),
x AS (SELECT *, CASE WHEN reason != 'passed' THEN 'model' WHEN key = model THEN 'retrieval_model_agree' WHEN model IS NULL AND form != 'agree_only' THEN 'retrieval_model_missing' WHEN form = 'override' THEN 'retrieval_override' ELSE 'model_fallback_disagree' END AS source FROM e)
SELECT form, row, reason, source, CASE WHEN source LIKE 'retrieval%' THEN key ELSE model END AS chosen, round(frac, 6) AS frac, round(margin, 6) AS margin FROM x""")
def strict_decisions(spark, sf_dir):
    """Strict decisions over the hits of orders whose model may have no key: missing-only, with override, and neither."""
    seen = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    hits = table(spark, sf_dir, "lineitem").where("l_tax > 0.01").select(F.col("l_orderkey").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("key"), (F.col("l_quantity") / 50).alias("similarity"), (F.col("l_discount") * 10).alias("jaccard"), seen.alias("ordinal"))
    priors = hits.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("prior"))
    told = hits.join(priors, F.col("key") == F.col("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "O", "NO").when(F.col("o_orderstatus") == "F", "RF").alias("model"))
    gate = {"least_sim": 0.5, "least_jaccard": 0.2, "least_frac": 0.5, "least_margin": 0.25}
    forms = {"missing_only": {}, "override": {"override": True}, "agree_only": {"fill": False}}
    done = [H.strict_decisions(orders, told, "row", "key", "model", gate, **how).select(F.lit(form).alias("form"), "row", "reason", "source", "chosen", F.round("frac", 6).alias("frac"), F.round("margin", 6).alias("margin")) for form, how in forms.items()]
    return J.union_all(done)


@query("""WITH k AS (SELECT regexp_replace(lower(p_name), '[0-9]+', '<num>', 'g') AS skeleton, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_partkey, k.p_brand AS answer, n FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[0-9]+', '<num>', 'g') AS skeleton FROM part) q JOIN k USING (skeleton)""")
def template_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[0-9]+", "<num>").alias("skeleton"), F.col("p_brand").alias("answer"))
    return R.lookup(parts.select("p_partkey", "skeleton"), parts, ["skeleton"], "answer").select("p_partkey", "answer", "n")


@query("""SELECT p_brand, count(*) AS support, round(avg(abs(a * p_partkey + b - p_retailprice) / greatest(1.0, p_retailprice)), 6) AS mean_error FROM part JOIN (SELECT p_brand, regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b FROM part GROUP BY 1) USING (p_brand) GROUP BY 1
HAVING count(*) >= 4 AND avg(abs(a * p_partkey + b - p_retailprice) / greatest(1.0, p_retailprice)) <= 0.02 AND max(abs(a * p_partkey + b - p_retailprice) / greatest(1.0, p_retailprice)) <= 0.1""")
def linear_templates(spark, sf_dir):
    """Brands whose prices are a linear function of the part's number."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.array(F.col("p_partkey").cast("double")).alias("numbers"), F.col("p_retailprice").alias("answer"))
    got = H.linear_templates(parts, "p_brand", "numbers", "answer")
    return got.select("p_brand", "support", F.round("mean_error", 6).alias("mean_error"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 6 < 3 THEN p_name || ' ' ELSE '' END || (p_size % 6) AS template, p_size % 6 AS form, 100000000.0 + p_partkey AS a, p_size::DOUBLE AS b FROM part),
s AS (SELECT template, count(*) AS n, count(DISTINCT b) AS m FROM t GROUP BY 1)
SELECT p_partkey, template, round(CASE form WHEN 0 THEN 3 * a - 2 * b + 7 WHEN 1 THEN a - b ELSE 0.5 * b + 4 END, 2) AS predicted FROM t JOIN s USING (template) WHERE n >= 4 AND form < 3""")
def template_predictions(spark, sf_dir):
    """Templates whose answers are linear in two numbers, one of them large beside its spread, fitted and applied to all parts."""
    form, a, b = F.col("p_size") % 6, 100000000.0 + F.col("p_partkey"), F.col("p_size").cast("double")
    crooked = F.when(F.col("p_partkey") % 2 == 0, 1000.0).otherwise(-1000.0) * (1 + F.col("p_partkey") % 7)
    answer = F.when(form == 0, 3 * a - 2 * b + 7).when(form == 1, a - b).when(form == 2, 0.5 * b + 4).otherwise(crooked)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(form < 3, F.concat("p_name", F.lit(" "))).otherwise(""), form.cast("string")).alias("template"), F.array(a, b).alias("numbers"), answer.alias("answer"))
    fits = H.linear_templates(parts, "template", "numbers", "answer")
    return H.apply_templates(parts, fits, "template", "numbers").select("p_partkey", "template", F.round("predicted", 2).alias("predicted"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN (p_partkey % 17)::VARCHAR END AS answer, CASE WHEN p_size > 0 THEN 'linear_equation' END AS rule FROM part")
def solved_questions(spark, sf_dir):
    """The template solver over equations made of parts."""
    a, x, b = F.col("p_size").cast("long"), F.col("p_partkey") % 17, F.col("p_partkey") % 50
    question = F.concat(F.lit("Giải phương trình "), a.cast("string"), F.lit("x + "), b.cast("string"), F.lit(" = "), (a * x + b).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", S.solved(question).alias("s")).select("p_partkey", "s.answer", "s.rule")


@query("""WITH t AS (SELECT p_partkey, p_name, p_size::DOUBLE AS a, (p_partkey % 90 + 10)::DOUBLE AS b FROM part)
SELECT p_partkey, lower('Mua ' || a::INT || ' ' || p_name || ' giá ' || b::INT || ' = 2 + 3') AS key, 4 AS n_numbers, sha1('Mua <num> ' || p_name || ' giá <num> = <num> + <num>') AS skeleton,
len(list_distinct([a, b, 2.0, 3.0, a + b + 5, a - 3, 3 - a, a * b * 6]))::INT AS n_values, 1 AS n_equations FROM t""")
def query_features(spark, sf_dir):
    """Key, numbers, skeleton, arithmetic values and equations of questions made of parts."""
    text = F.concat(F.lit("Mua "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" giá "), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(" = 2 + 3"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("nums", T.query_numbers("text"))
    return rows.select("p_partkey", T.text_key("text").alias("key"), F.size("nums").alias("n_numbers"), T.digest(T.skeleton("text")).alias("skeleton"), F.size(A.arithmetic_values("nums")).alias("n_values"), F.size(A.equations("text")).alias("n_equations"))


@query(r"""SELECT doc_id, sha1(text) AS digest, CASE WHEN trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ')) END::INT AS parts, length(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '', 'g'))::INT AS word_chars,
array_to_string(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ')[1:8], ' ') AS head, array_to_string(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ')[-8:], ' ') AS tail,
starts_with(text, 'The ') AS starts_the, regexp_matches(text, '\$[^$]+\$') AS has_dollar_math FROM documents WHERE text IS NOT NULL""")
def document_measures(spark, sf_dir):
    """Digest, parts between white space, word characters, first and last parts, and flags of every document."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    flags = T.flags("text", {"starts_the": "The "})
    return docs.select("doc_id", T.digest("text").alias("digest"), T.space_count("text").alias("parts"), F.length(T.alnum_only("text")).alias("word_chars"), T.cap_words("text", 8).alias("head"), T.cap_words("text", 8, tail=True).alias("tail"), flags["starts_the"].alias("starts_the"), flags["has_dollar_math"].alias("has_dollar_math"))



from . import composites, files, worded  # noqa: E402, F401  (they register queries of their own)
