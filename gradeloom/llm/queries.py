"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linechunks, phrases, quality, sharding, shared, shinglejoin, spans, templates, tokencounts, veccodes, warczip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.link_documents(table(spark, sf_dir, "documents"))


#: SHA-1 in base32: its 160 bits in groups of five.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits FROM p),
d AS (SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + 5 * i, 5))::INT, 1)), '') AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM b)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS intact FROM d
"""


#: All pairs that share a shingle are counted; components by following the least label along links.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN ['!' || array_to_string(words, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM sets),
rs AS (SELECT s.doc_id, g FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.doc_id = rep.r),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT r AS node, r AS seen FROM (SELECT DISTINCT r FROM rep) UNION SELECT node, e.v FROM reach JOIN e ON e.u = seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN c ON c.node = rep.r
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, shared.fresh(spark, "shards"))
    for arrival in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == arrival))
    store.compact()
    store.vacuum(grace_seconds=0)  # no other writer knows this store
    return store.snapshot().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Sentences are runs of words with the white space behind them; a span's first place is its least (doc_id, sentence).
OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS toks FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t),
e AS (SELECT *, regexp_extract(tok, '^[^\x20\x09-\x0D]+') AS word FROM w),
s AS (SELECT *, coalesce(sum((contains(tok, chr(10)) OR regexp_matches(word, '[.!?]["'')\]}]?$'))::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM e),
g AS (SELECT doc_id, sent, string_agg(tok, '' ORDER BY i) AS body, string_agg(word, ' ' ORDER BY i) AS ws, count(*) AS n FROM s GROUP BY 1, 2),
l AS (SELECT doc_id, sent, ws, n, lead(ws, 1) OVER o AS ws1, lead(n, 1) OVER o AS n1, lead(ws, 2) OVER o AS ws2, lead(n, 2) OVER o AS n2 FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY sent)),
sp AS (
  SELECT doc_id, sent, 3 AS k, ws || ' ' || ws1 || ' ' || ws2 AS h FROM l WHERE n2 IS NOT NULL
  UNION ALL SELECT doc_id, sent, 2, ws || ' ' || ws1 FROM l WHERE n + n1 >= 20 UNION ALL SELECT doc_id, sent, 1, ws FROM l WHERE n >= 50
),
r AS (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY doc_id, sent) > 1 AS again FROM sp),
cut AS (SELECT DISTINCT doc_id, sent + j AS sent FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE again AND j < k),
k AS (SELECT doc_id, string_agg(body, '' ORDER BY sent) FILTER (cut.sent IS NULL) AS rest, count(cut.sent) AS n_cut FROM g LEFT JOIN cut USING (doc_id, sent) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.lead || coalesce(k.rest, '') END AS text, coalesce(n_cut, 0) AS n_sentences_cut FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_FOLDED = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in licenses.TEMPLATES.items())
OP3_SQL = f"""
WITH tpl(license, body) AS (VALUES {_TEMPLATES}),
tw AS (SELECT license, {_FOLDED.format("body")} AS w FROM tpl), tb AS (SELECT license, unnest({_BIGRAMS}) AS g FROM tw), ts AS (SELECT license, count(*) AS t FROM tb GROUP BY 1),
u AS (
  SELECT doc_id, 2 AS kind, 0 AS no, text AS x FROM documents
  UNION ALL SELECT doc_id, 0, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, 1, generate_subscripts(string_split(text, chr(10) || chr(10)), 1), unnest(string_split(text, chr(10) || chr(10))) FROM documents WHERE contains(text, chr(10))
), w AS (SELECT doc_id, kind, no, {_FOLDED.format("x")} AS w FROM u), b AS (SELECT doc_id, kind, no, {_BIGRAMS} AS gs FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, kind, no, len(gs) AS a, unnest(gs) AS g FROM b),
m AS (SELECT doc_id, kind, no, license, any_value(a) AS a, any_value(t) AS t, count(*) AS k FROM c JOIN tb USING (g) JOIN ts USING (license) GROUP BY 1, 2, 3, 4),
h AS (SELECT *, 2 * k::DOUBLE / (a + t) AS score FROM m WHERE 10 * k >= 4 * (a + t)),
best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, kind) = 1),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, kind, no FROM h) GROUP BY 1)
SELECT d.doc_id, license, coalesce(score, 0.0::DOUBLE) AS score, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'text' END AS unit, coalesce(n.n, 0) AS n_matches
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OTHER = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*"
_UNITS = ", ".join(f"'{u}'" for u in templates.UNITS)
#: Tokens with their codes, windows by key, and the map of values that the matches of a document and item agree on.
OP4_SQL = rf"""
WITH t AS (
  SELECT 'd' AS src, doc_id AS id, row_number() OVER () AS r, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark WHERE text IS NOT NULL
), p AS (SELECT src, id, r, regexp_extract_all(text, '{_OTHER}(?:[0-9]+(?:[.,][0-9]+)*|[A-Za-z\x{{80}}-\x{{10FFFF}}]+)') AS ps FROM t),
q AS (SELECT src, id, r, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
s AS (SELECT src, id, r, i, regexp_extract(piece, '^{_OTHER}') AS sep, regexp_replace(piece, '^{_OTHER}', '') AS raw FROM q),
k AS (SELECT *, regexp_matches(raw, '^[0-9]') AS number, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM s),
c AS (
  SELECT src, id, r, i, word, CASE WHEN number THEN '#1' WHEN coalesce(lag(number) OVER (PARTITION BY src, r ORDER BY i), false) AND word IN ({_UNITS}) THEN '#3'
    WHEN regexp_matches(raw, '^[A-Z\x{{C0}}-\x{{DE}}]') AND i > 1 AND NOT regexp_matches(sep, '[\n!.?]') THEN '#2' ELSE word END AS code FROM k
), l AS (SELECT src, id, r, list(code ORDER BY i) AS codes, list(word ORDER BY i) AS words FROM c GROUP BY 1, 2, 3),
sized AS (
  SELECT *, least(8, len(codes)) AS size FROM l WHERE src = 'b' AND len(codes) >= 4
  UNION ALL SELECT l.*, z.size FROM l, (SELECT DISTINCT least(8, len(codes)) AS size FROM l WHERE src = 'b' AND len(codes) >= 4) z WHERE src = 'd' AND len(codes) >= z.size
), w AS (SELECT src, id, r, size, unnest(range(1, len(codes) - size + 2)) AS pos, codes, words FROM sized),
v AS (SELECT src, id, r, size, pos, codes[pos:pos + size - 1] AS cs, words[pos:pos + size - 1] AS ws FROM w),
x AS (SELECT *, len(list_filter(cs, lambda e: e[1] != '#')) >= CASE WHEN size = 8 THEN 5 ELSE 4 END AS plain FROM v),
y AS (SELECT *, CASE WHEN plain THEN 'T ' || array_to_string(cs, ' ') ELSE 'V ' || array_to_string(ws, ' ') END AS key FROM x),
n AS (SELECT r, count(DISTINCT key) AS item_windows FROM y WHERE src = 'b' GROUP BY r),
m AS (SELECT d.r AS drow, d.id AS doc_id, b.r AS brow, b.id AS item_id, d.key, d.pos AS here, d.pos - b.pos AS shift, d.plain, d.size, d.cs, b.ws AS xs, d.ws AS ys FROM y d JOIN y b ON d.src = 'd' AND b.src = 'b' AND d.key = b.key),
e AS (SELECT * EXCLUDE (cs, xs, ys, plain, size), unnest(range(1, size + 1)) AS j, unnest(cs) AS code, unnest(xs) AS xv, unnest(ys) AS yv, plain FROM m),
o AS (SELECT * EXCLUDE (code, xv, yv, plain), CASE WHEN slot THEN code END AS kind, CASE WHEN slot THEN xv END AS x, CASE WHEN slot THEN yv END AS y FROM (SELECT *, plain AND code[1] = '#' AS slot FROM e)),
t1 AS (SELECT *, coalesce(kind = '#2' AND min(y) OVER g != max(y) OVER g, false) AS torn FROM o WINDOW g AS (PARTITION BY drow, brow, shift, kind, x)),
t2 AS (SELECT *, bool_or(torn) OVER g AS bad, count(*) FILTER (j = 1) OVER g AS n_aligned FROM t1 WINDOW g AS (PARTITION BY drow, brow, shift)),
t3 AS (SELECT *, dense_rank() OVER (PARTITION BY drow, brow ORDER BY n_aligned DESC, shift) AS place FROM t2 WHERE NOT bad),
t4 AS (SELECT *, count(*) OVER g AS support, min(here * 8 + j) OVER g AS seen FROM t3 WINDOW g AS (PARTITION BY drow, brow, kind, x, place, y)),
t5 AS (SELECT *, kind IS NULL OR y = first_value(y) OVER (PARTITION BY drow, brow, kind, x ORDER BY place, support DESC, seen) AS agrees FROM t4),
a AS (SELECT drow, brow, doc_id, item_id, key, here, shift, bool_and(agrees) AS agrees, bool_and(coalesce(x = y, true)) AS same FROM t5 GROUP BY ALL),
f AS (SELECT drow, brow, doc_id, item_id, count(DISTINCT key) AS n_windows, min(here) - 1 AS first_token, bool_and(same) AS same FROM a WHERE agrees GROUP BY ALL)
SELECT doc_id, item_id, n_windows, item_windows, first_token, CASE WHEN same THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM f JOIN n ON n.r = f.brow WHERE n_windows >= 6 OR 2 * n_windows >= item_windows
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Rows of the documents without the lines that repeated chunks of any grading cover.
OP5_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS x FROM l),
p AS (SELECT *, x + 31 * lag(x, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS r, unnest(range(0, {linechunks.PHASES})) AS phase FROM h),
k AS (SELECT *, coalesce(sum(((r >> ({linechunks.STRIDE} * phase)) % 2 = 0)::INT) OVER (PARTITION BY doc_id, phase ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM p),
c AS (SELECT doc_id, phase, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY doc_id, phase, chunk),
d AS (SELECT DISTINCT doc_id, start, n, body FROM c WHERE n > 1),
g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AS cut FROM d),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM g WHERE cut),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS text, count(gone.i) AS n_lines_cut FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_lines_cut, 0) AS n_lines_cut FROM documents d LEFT JOIN t USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


#: Words of a text, and a line's normalised form.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
pos AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
raw AS (SELECT r, source, coalesce(doc_id::VARCHAR, 'row ' || r) AS t, unnest(lines) AS line FROM w),
norm AS (SELECT r, source, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM raw),
full_lines AS (SELECT r, source, t, line, array_to_string(ws, ' ') AS n, len(ws) AS k FROM norm WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
common AS (SELECT coalesce(source, chr(0)) AS source, n FROM full_lines GROUP BY 1, 2 HAVING count(DISTINCT t) > 100),
cut AS (SELECT r, sum(k) AS words, count(DISTINCT n) AS lines FROM full_lines JOIN common USING (n) WHERE coalesce(full_lines.source, chr(0)) = common.source GROUP BY r),
m AS (
  SELECT doc_id, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(w.words) - coalesce(cut.words, 0))::BIGINT AS n_words_left, coalesce(cut.lines, 0)::BIGINT AS n_lines_cut
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words_left >= 50 AND n_words_left >= 0.5 * n_words AS kept FROM f
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.learn(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, where = warczip.archive(table(spark, sf_dir, "pages"))
    spread = packages.repartition(max(1, packages.count()))
    return warczip.read(spread, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


#: Runs of one, two and three words of a piece, counted by grouping.
OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
s AS (
  SELECT c.*, cut, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, array_to_string(ws[o:o + 1], ' ') AS phrase, a FROM c, (SELECT unnest([1, 2]) AS o) WHERE k = 3) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""


#: More tokens are over the limit.
TOKEN_LIMIT = 512


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.codes(table(spark, sf_dir, "embeddings"))


_DISTANCE = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
_NEAREST = f"SELECT r, part, min(struct_pack(d := {_DISTANCE}, e := entry)) AS best FROM p JOIN {{}} USING (part) GROUP BY r, part"
_MOVED = """
SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM {} o LEFT JOIN (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT part, best.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM p JOIN {} USING (r, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL
  ) GROUP BY part, entry
) n USING (part, entry)
"""
#: Every part beside every entry of its codebook.
OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(0, 16)) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_NEAREST.format("c0")}), c1 AS MATERIALIZED ({_MOVED.format("c0", "a0")}),
a1 AS MATERIALIZED ({_NEAREST.format("c1")}), c2 AS MATERIALIZED ({_MOVED.format("c1", "a1")}),
a2 AS MATERIALIZED ({_NEAREST.format("c2")}),
e AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM k JOIN e USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_spans": op2_spans,
    "op3_licenses": op3_licenses,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_warc": op8_warc,
    "op9_shingle_join": op9_shingle_join,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {"op1_sharding": OP1_SQL, "op2_spans": OP2_SQL, "op3_licenses": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_quality": OP6_SQL, "op8_warc": OP8_SQL, "op9_shingle_join": OP9_SQL, "op11_phrases": OP11_SQL, "op13_vector_codes": OP13_SQL}
