"""Registered queries of functions on texts that are worded from table columns.

Each row of ``part`` gets the wording of its number (k) modulo the number of wordings, with its size (s) and name (n)
in it.  Both engines word the texts by the same SQL expressions; the results are computed from the columns by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import sequence
from .functions import solver as S
from .functions import text as T
from .operators import vote as V
from .plans import report, retrieval
from .queries import query, table

SOURCE = "(SELECT p_partkey AS k, p_size AS s, p_name AS n FROM part)"
#: A null text, an anchor's line break, and a backslash, in the SQL of both engines.
NOTHING, BREAK, SLASH = "nullif('', '')", "chr(10)", "chr(92)"


def by_number(options: list[str]) -> str:
    """The option of the row's number."""
    return f"CASE k % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def worded(spark: SparkSession, sf_dir: str, **texts: list[str]) -> DataFrame:
    """k, s, n and the worded texts of every part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_name").alias("n"))
    return rows.withColumns({name: F.expr(by_number(options)) for name, options in texts.items()})


def told(wordings: list[tuple[str, ...]], *columns: str, texts: int = 1) -> str:
    """SQL of the result columns (name and type each) that stand behind the ``texts`` of each wording."""
    parts = [f"{by_number([f'({w[texts + i]})::{c.split()[1]}' for w in wordings])} AS {c.split()[0]}" for i, c in enumerate(columns)]
    return f"SELECT k, {', '.join(parts)} FROM {SOURCE}"


def column(wordings: list[tuple[str, ...]], at: int = 0) -> list[str]:
    return [w[at] for w in wordings]


# Text; answer and anchor of the last anchor; answer of the older rule that takes the first anchor of the list.
EXTRACTED = [
    (f"'Ta có 3 + ' || s || ' = ' || (s + 3) || '.' || {BREAK} || 'Đáp án là: ' || (s + 3)", "s + 3", "'dap_an_la'", "s + 3"),
    ("'#### ' || s", "s", "'hash4'", "s"),
    (f"'#### ' || k || {BREAK} || 'The answer is: ' || s || '.'", "s", "'the_answer_is'", "s"),
    ("'The answer is ' || k || '. Đáp án là: ' || s || ' cm'", "s", "'dap_an_la'", "s"),
    (f"'Đáp án là: ' || k || {BREAK} || 'rồi #### ' || s", "s", "'hash4'", "k"),
    ("'Câu trả lời là: ' || s || ',5 đồng'", "s || ',5'", "'cau_tra_loi_la'", "s || ',5'"),
    ("'ĐÁP ÁN LÀ ' || s || ';'", "s", "'dap_an_la'", "s"),
    ("'Đáp án: -' || s || ' km2 nữa'", "'-' || s", "'dap_an'", "'-' || s"),
    (f"'Vậy ' || {SLASH} || 'boxed{{' || {SLASH} || 'frac{{1}}{{2}}}} và ' || {SLASH} || 'boxed{{' || s || '}}'", "s", "'boxed'", "s"),
    (f"{SLASH} || 'boxed{{' || {SLASH} || 'frac{{' || s || '}}{{7}}}}'", f"{SLASH} || 'frac{{' || s || '}}{{7}}'", "'boxed'", f"{SLASH} || 'frac{{' || s || '}}{{7}}'"),
    ("n || ' ' || s", "NULL", "NULL", "NULL"),
    (NOTHING, "NULL", "NULL", "NULL"),
]


@query(told(EXTRACTED, "answer VARCHAR", "anchor VARCHAR", "first_answer VARCHAR"))
def extracted_answers(spark, sf_dir):
    rows = worded(spark, sf_dir, t=column(EXTRACTED))
    return rows.select("k", A.extracted("t").alias("a"), A.extracted("t", first=True).alias("f")).select("k", "a.answer", "a.anchor", F.col("f.answer").alias("first_answer"))


_QUARTERS = "CASE s % 4 WHEN 0 THEN (s // 4)::VARCHAR WHEN 2 THEN (s // 4) || '.5' ELSE (s // 4) || CASE s % 4 WHEN 1 THEN '.25' ELSE '.75' END END"
# Text; number, loose number, form, canonical text of six digits and key of ten.
PARSED = [
    ("'' || s", "s", "s", "'integer'", "s", "s"),
    ("'-' || s", "-s", "-s", "'negative_integer'", "-s", "-s"),
    ("s || ',5'", "s + 0.5", "10 * s + 5", "'decimal_comma'", "s || '.5'", "s || '.5'"),
    ("'-' || s || ',5'", "-s - 0.5", "-10 * s - 5", "'negative_decimal_comma'", "'-' || s || '.5'", "'-' || s || '.5'"),
    ("s || '.50'", "s + 0.5", "s + 0.5", "'decimal_dot'", "s || '.5'", "s || '.5'"),
    ("'-' || s || '.5'", "-s - 0.5", "-s - 0.5", "'negative_decimal_dot'", "'-' || s || '.5'", "'-' || s || '.5'"),
    ("s || 'e3'", "1000 * s", "s", "'scientific'", "1000 * s", "1000 * s"),
    ("'-' || s || 'E2'", "-100 * s", "-s", "'negative_scientific'", "-100 * s", "-100 * s"),
    ("'1,234,' || (500 + s)", "1234500 + s", "1234500 + s", "'numeric_other'", "1234500 + s", "1234500 + s"),
    (f"{SLASH} || 'frac{{' || s || '}}{{4}}'", "s / 4", "s", "'numeric_other'", _QUARTERS, _QUARTERS),
    (f"{SLASH} || 'dfrac{{' || (3 * s + 1) || '}}{{3}}'", "(3 * s + 1) / 3", "3 * s + 1", "'numeric_other'", "s || '.' || repeat('3', 6 - length(s::VARCHAR))", "s || '.' || repeat('3', 10 - length(s::VARCHAR))"),
    (f"s || {SLASH} || 'sqrt{{9}}'", "3 * s", "s", "'numeric_other'", "3 * s", "3 * s"),
    ("'x = ' || s", "s", "s", "'numeric_other'", "s", "s"),
    ("s || '^2'", "s * s", "s", "'numeric_other'", "s * s", "s * s"),
    ("'2^' || (s % 20)", "2 ** (s % 20)", "2", "'numeric_other'", "(2 ** (s % 20))::BIGINT", "(2 ** (s % 20))::BIGINT"),
    ("'$' || s || '$'", "s", "s", "'numeric_other'", "s", "s"),
    ("'(' || s || ', 2)'", "NULL", "s", "'non_numeric'", "NULL", "NULL"),
    ("'[' || s || ', 2]'", "NULL", "s", "'non_numeric'", "NULL", "NULL"),
    ("'x + ' || s", "NULL", "s", "'non_numeric'", "NULL", "NULL"),
    ("s || '(4)'", "4 * s", "s", "'numeric_other'", "4 * s", "4 * s"),
    ("s || '/0'", "NULL", "s", "'non_numeric'", "NULL", "NULL"),
    ("s || '.25+0.5'", "s + 0.75", "s + 0.25", "'numeric_other'", "s || '.75'", "s || '.75'"),
    ("n", "NULL", "NULL", "'non_numeric'", "NULL", "NULL"),
    (NOTHING, "NULL", "NULL", "'missing'", "NULL", "NULL"),
]


@query(f"SELECT *, key::DOUBLE AS back FROM ({told(PARSED, 'num DOUBLE', 'simple DOUBLE', 'form VARCHAR', 'canonical VARCHAR', 'key VARCHAR')})")
def parsed_numbers(spark, sf_dir):
    rows = worded(spark, sf_dir, t=column(PARSED)).withColumn("num", A.parsed("t"))
    done = rows.select("k", "num", A.simple_number("t").alias("simple"), A.answer_form("t", "num").alias("form"), A.keyed("num", 6).alias("canonical"), A.keyed("num").alias("key"))
    return done.withColumn("back", A.number_from_key("key"))


@query("""WITH c AS (SELECT l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + l_linenumber * 4e-10) AS b FROM lineitem)
SELECT l_linenumber, coalesce(abs(a - b) <= 1e-9 * greatest(1.0, abs(a), abs(b)), false) AS relative, coalesce(abs(a - b) <= 1e-9, false) AS absolute, count(*) AS n FROM c GROUP BY ALL""")
def close_numbers(spark, sf_dir):
    """Prices beside prices that differ by a few parts in ten thousand million."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 4e-10)).alias("b"))
    return rows.groupBy("l_linenumber", A.close("a", "b").alias("relative"), A.close("a", "b", relative=False).alias("absolute")).agg(F.count("*").alias("n"))


# Text; output line, text behind artifacts, normalised response with the part's number as the answer.
CLEANED = [
    ("'Đáp án là: ' || s || ',50 hue'", "'Đáp án là: ' || s || '.5'", "'Đáp án là: ' || s || ',50'", f"{BREAK} || 'Đáp án là: ' || k"),
    ("'so #### ' || s || '</s><pad>'", "'Đáp án là: ' || s", "'so #### ' || s", f"'so' || {BREAK} || 'Đáp án là: ' || k"),
    ("n || '<|endoftext|>'", "n", "n", f"n || '<|endoftext|>' || {BREAK} || 'Đáp án là: ' || k"),
    (f"n || {BREAK} || '#### 3' || {BREAK} || '#### ' || s", "'Đáp án là: ' || s", f"n || {BREAK} || '#### 3' || {BREAK} || '#### ' || s", f"n || {BREAK} || 'Đáp án là: ' || k"),
]


@query(told(CLEANED, "line VARCHAR", "clean VARCHAR", "response VARCHAR"))
def cleaned_outputs(spark, sf_dir):
    rows = worded(spark, sf_dir, t=column(CLEANED))
    return rows.select("k", A.sanitized("t").alias("line"), T.clean_artifacts("t").alias("clean"), A.normalized_response("t", F.col("k")).alias("response"))


_ROUND = "substr('①②③④⑤⑥⑦⑧⑨', s % 9 + 1, 1)"
_THIRD = f"'Cho ' || {SLASH} || 'frac{{1}}{{' || s || '}} và -4, x2'"
# Text; key, strip, casefold_space, casefold_alnum, NFC folded, word characters alone, mask, numbers, skeleton.
KEYS = [
    (f"'  Tổng  CỦA ' || s || ',5 và ' || {BREAK} || ' 12 '", "'tổng của ' || s || ',5 và 12'", f"'Tổng  CỦA ' || s || ',5 và ' || {BREAK} || ' 12'", "'tổng của ' || s || ',5 và 12'", "'tổng của ' || s || ' 5 và 12'",
     f"'  tổng  của ' || s || ',5 và ' || {BREAK} || ' 12 '", "'TổngCỦA' || s || '5và12'", f"'  Tổng  CỦA <NUM> và ' || {BREAK} || ' <NUM> '", "s || ',5|12'", "'Tổng CỦA <num> và <num>'"),
    (f"'Straße ﬁve ' || {_ROUND}", "'straße five ' || (s % 9 + 1)", "'Straße five ' || (s % 9 + 1)", "'strasse five ' || (s % 9 + 1)", "'strasse five ' || (s % 9 + 1)", f"'strasse five ' || {_ROUND}", "'Straßeﬁve'", f"'Straße ﬁve ' || {_ROUND}", "''", f"'Straße ﬁve ' || {_ROUND}"),
    (_THIRD, f"lower({_THIRD})", _THIRD, f"lower({_THIRD})", "'cho frac 1 ' || s || ' và 4 x2'", f"lower({_THIRD})", "'Chofrac1' || s || 'và4x2'", f"'Cho ' || {SLASH} || 'frac{{<NUM>}}{{<NUM>}} và <NUM>, x2'", "'1|' || s || '|-4'", "'Cho <num> và <num> , x2'"),
    ("upper(n)", "n", "upper(n)", "n", "n", "n", "replace(upper(n), ' ', '')", "upper(n)", "''", "upper(n)"),
    ("''", *["''"] * 9),
]


@query(told(KEYS, *(f"{c} VARCHAR" for c in ("key", "strip", "folded", "alnum", "nfc", "plain", "mask", "numbers", "skeleton"))))
def text_keys(spark, sf_dir):
    return worded(spark, sf_dir, t=column(KEYS)).select(
        "k", T.text_key("t").alias("key"), T.normalize("t", "strip").alias("strip"), T.normalize("t", "casefold_space").alias("folded"), T.normalize("t", "casefold_alnum").alias("alnum"), T.compat("t", "NFC", fold=True).alias("nfc"),
        T.alnum_only("t").alias("plain"), T.mask_numbers("t").alias("mask"), F.array_join(T.numbers("t"), "|").alias("numbers"), T.skeleton("t").alias("skeleton"),
    )


# Query, original query; query key, group key.
GROUPS = [("' Hai  TÁO ' || s", NOTHING, "'hai táo ' || s", "'source_id:' || k"), ("''", "'Two  Apples ' || s", "'query_id:' || k", "'original:two apples ' || s"), (NOTHING, "'  '", "'query_id:' || k", "'source_id:' || k")]


@query(told(GROUPS, "query_key VARCHAR", "group_key VARCHAR", texts=2))
def group_keys(spark, sf_dir):
    rows = worded(spark, sf_dir, q=column(GROUPS), original=column(GROUPS, 1))
    fallback = F.concat(F.lit("source_id:"), F.col("k").cast("string"))
    return rows.select("k", T.query_key("q", "k").alias("query_key"), T.first_filled(["original"], fallback).alias("group_key"))


def _doubles(*xs: str) -> str:
    return " || ',' || ".join(f"({x})::DOUBLE::VARCHAR" for x in xs)


# Two queries; whether their numbers agree, those of the first, and what arithmetic makes of them.
PAIRS = [
    ("n", "n || '?'", "true", "''", "''"),
    ("(s + 100) || ' táo và 7 cam'", "(s + 100) || ' cam và 7 táo'", "true", _doubles("s + 100", "7"), _doubles("s + 100", "7", "s + 107", "s + 93", "-s - 93", "7 * (s + 100)")),
    (f"{SLASH} || 'frac{{1}}{{2}} của ' || (s + 9)", "(s + 9) || ' và 0,5'", "false", _doubles("0.5", "s + 9"), _doubles("0.5", "s + 9", "s + 9.5", "-s - 8.5", "s + 8.5", "(s + 9) / 2")),
    ("(s + 100) || ' và ' || (s + 100)", "(s + 100) || ' và ' || (s + 100)", "true", _doubles("s + 100", "s + 100"), _doubles("s + 100", "2 * s + 200", "0", "(s + 100) * (s + 100)")),
]


@query(told(PAIRS, "same BOOLEAN", "numbers VARCHAR", "made VARCHAR", texts=2))
def number_signatures(spark, sf_dir):
    rows = worded(spark, sf_dir, a=column(PAIRS), b=column(PAIRS, 1)).withColumn("x", T.query_numbers("a")).withColumn("y", T.query_numbers("b"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("k", T.same_numbers("x", "y").alias("same"), joined(F.col("x")).alias("numbers"), joined(A.arithmetic_values("x", cap=6)).alias("made"))


# Two texts; their sequence ratio.
RATIOS = [
    ("repeat('a', s) || 'x'", "repeat('a', CAST(k % 40 AS INT)) || 'y'", "2 * least(s, k % 40) / (s + k % 40 + 2)"), ("repeat('ab', s)", "repeat('ba', s)", "(2 * s - 1) / (2 * s)"),
    ("n || repeat('z', s)", "n", "2 * length(n) / (2 * length(n) + s)"), ("repeat('q', 200 + s)", "repeat('q', 200 + s)", "1"), ("''", "n", "0"), (NOTHING, "n", "NULL"),
]


@query(f"SELECT k, round(ratio, 6) AS ratio FROM ({told(RATIOS, 'ratio DOUBLE', texts=2)})")
def text_ratios(spark, sf_dir):
    return worded(spark, sf_dir, a=column(RATIOS), b=column(RATIOS, 1)).select("k", F.round(sequence.ratio("a", "b"), 6).alias("ratio"))


# Answer, query; whether it stands there.
LITERALS = [
    ("'$' || s || '.5'", "'giá ' || s || ',5 đồng'", "true"), ("'' || s", "'có ' || s || ' quả'", "true"), ("'' || (s + 1000)", "'có ' || s || ' quả'", "false"), ("''", "n", "false"), (NOTHING, "n", "false"),
    ("'1234567890123456789' || (s + 10)", "'1234567890123456789' || (s + 10)", "false"),
]


@query(told(LITERALS, "inside BOOLEAN", texts=2))
def answer_literals(spark, sf_dir):
    return worded(spark, sf_dir, a=column(LITERALS), q=column(LITERALS, 1)).select("k", T.literal_in("a", "q").alias("inside"))


_SUM, _TIMES = "'Ta có ' || s || '.5 + 1 = ' || (s + 1) || '.5.'", "s || '*3 = ' || (3 * s) || ' và ' || s || ' * 3 = ' || (3 * s) || ', 12/4=3'"
# Text; sentences, chunks, last two sentences, equations.
SPLITS = [
    (f"{_SUM} || ' Vậy xong! Hết'", f"{_SUM} || '|Vậy xong!|Hết'", f"{_SUM} || '|Vậy xong!|Hết'", "'Vậy xong! Hết'", "s || '.5 + 1 = ' || (s + 1) || '.5'"),
    (f"'- a; b' || s || {BREAK} || '• ' || n", "'a; b' || s || '|' || n", "'a|b' || s || '|' || n", "'a; b' || s || ' ' || n", "''"),
    (_TIMES, _TIMES, _TIMES, _TIMES, "s || '*3 = ' || (3 * s) || '|' || s || ' * 3 = ' || (3 * s) || ', 12/4=3'"),
]


@query(told(SPLITS, "sentences VARCHAR", "chunks VARCHAR", "last VARCHAR", "equations VARCHAR"))
def split_reasons(spark, sf_dir):
    joined = lambda c: F.array_join(c, "|")
    return worded(spark, sf_dir, t=column(SPLITS)).select("k", joined(T.sentences("t")).alias("sentences"), joined(T.chunks("t")).alias("chunks"), T.last_sentences("t", 2).alias("last"), joined(A.equations("t")).alias("equations"))


_ADDED = "'Ta có ' || s || ' + 4 = ' || (s + 4) || '.'"
# Text; body, compact reasoning, anchors, answer first, characters before and behind.
REASONS = [
    (f"{_ADDED} || ' Vậy xong.' || {BREAK} || 'Đáp án là: ' || (s + 4)", f"{_ADDED} || ' Vậy xong.'", _ADDED, "1", "false", f"length({_ADDED}) + 10", "length((s + 4)::VARCHAR)"),
    (f"'Có ' || {SLASH} || 'boxed{{' || s || '}} quả. Rồi thêm 3. Thôi. Đáp án là: 5 Đáp án là: 6'", "'Có ' || s || ' quả. Rồi thêm 3. Thôi. Đáp án là: 5'", "'Rồi thêm 3. Đáp án là: 5'", "2", "false", "47 + length(s::VARCHAR)", "1"),
    ("'Đáp án là: ' || s", "''", "''", "1", "true", "0", "length(s::VARCHAR)"),
    ("n", "n", "n", "0", "false", "0", "0"),
]


@query(told(REASONS, "body VARCHAR", "compact VARCHAR", "anchors INT", "answer_first BOOLEAN", "reason_chars INT", "tail_chars INT"))
def compact_reasons(spark, sf_dir):
    rows = worded(spark, sf_dir, t=column(REASONS))
    return rows.select("k", A.without_tail("t").alias("body"), A.compact_reasoning("t").alias("compact"), A.anchor_layout("t").alias("l")).select("k", "body", "compact", "l.*")


# Text; shape, equality signs before the anchor, the text again.
SHAPES = [(t, *rest, t) for t, *rest in (
    ("'Phương trình: ' || s || ' + 1 = ' || (s + 1) || ' Đáp án là: ' || (s + 1)", "'equation_plus_answer'", "1"), ("'Đáp án là: ' || s", "'answer_only'", "0"),
    ("'x = ' || s || ' = y. Đáp án là: 2'", "'other_with_answer_anchor'", "2"), ("n", "'no_answer_anchor'", "0"), (NOTHING, "'no_answer_anchor'", "0"))]


@query(f"SELECT k, shape, equals, 'Câu hỏi: ' || coalesce(t, '') || {BREAK} AS prompt, CASE WHEN k % 2 = 1 THEN 'Đáp án là: 5' ELSE coalesce(t, '') END AS item FROM ({told(SHAPES, 'shape VARCHAR', 'equals INT', 't VARCHAR')})")
def output_shapes(spark, sf_dir):
    rows = worded(spark, sf_dir, t=column(SHAPES)).withColumn("key", F.when(F.col("k") % 2 == 1, "5"))
    shape = A.output_shape("t", "Phương trình:", "Đáp án là:", "Đáp án là:")
    return rows.select("k", shape.alias("o"), A.prompt("t").alias("prompt"), A.answer_item("key", "t").alias("item")).select("k", "o.*", "prompt", "item")


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN 'VD: 1+1=2' || {BREAK} ELSE '' END || 'Câu hỏi: hai cộng ' || s || {BREAK} AS prompt FROM {SOURCE}")
def prompts_with_examples(spark, sf_dir):
    rows = worded(spark, sf_dir, kind=["'GSM'", "'MATH'"], q=["' hai cộng ' || s || ' '"])
    return rows.select("k", A.prompt_with_examples("q", "kind", {"GSM": "VD: 1+1=2\n"}).alias("prompt"))


@query(f"""WITH r AS (SELECT k, CASE s % 4 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 0 END AS p, s % 3 > 0 AS e, k % 2 = 0 AS q, 10 * (s % 15) AS t, k % 3 > 0 AS f, k % 5 = 0 AS a, s AS c, k % 7 = 0 AS m FROM {SOURCE})
SELECT k, round(greatest(0.0, least(1.2, p / 10 + CASE WHEN e THEN 0.15 ELSE -0.20 END + CASE WHEN t <= 64 THEN 0.05 WHEN t > 96 THEN -0.05 ELSE 0 END + CASE WHEN q THEN 0.05 ELSE 0 END))::DOUBLE, 6) AS plain,
round(greatest(0.0, least(1.4, p / 10 + CASE WHEN f THEN 0.20 ELSE -0.30 END + CASE WHEN a THEN -0.35 ELSE 0.10 END + CASE WHEN c >= 24 THEN 0.15 ELSE -0.15 END + CASE WHEN q THEN 0.10 ELSE 0 END + CASE WHEN m THEN -0.10 ELSE 0 END + CASE WHEN t BETWEEN 32 AND 96 THEN 0.05 WHEN t < 12 OR t > 128 THEN -0.10 ELSE 0 END))::DOUBLE, 6) AS layout FROM r""")
def rewards(spark, sf_dir):
    k, s = F.col("k"), F.col("s")
    points, tokens = F.when(s % 4 == 0, 10).when(s % 4 == 1, 5).when(s % 4 == 2, 1).otherwise(0), 10 * (s % 15)
    plain = A.reward(points, s % 3 > 0, k % 2 == 0, tokens)
    layout = A.layout_reward(points, k % 3 > 0, k % 5 == 0, s, k % 2 == 0, k % 7 == 0, tokens)
    return worded(spark, sf_dir).select("k", F.round(plain, 6).alias("plain"), F.round(layout, 6).alias("layout"))


# Query; distractor points.
DISTRACTORS = [("'lan có ' || s || ' quả, 4 quả, 5 quả và 6 quả'", "1"), ("'tìm x biết ' || s || '% của x là 5'", "3"), ("s || ' 2 3 4 5 6 neu 7'", "3"), ("n", "0"), (NOTHING, "0")]


@query(told(DISTRACTORS, "points INT"))
def distractor_scores(spark, sf_dir):
    return worded(spark, sf_dir, q=column(DISTRACTORS)).select("k", A.distractor_score("q").alias("points"))


# Service response; text, JSON object in it.
RESPONSES = [
    (f"""'{{"output_text": "a {{' || {SLASH} || '"x' || {SLASH} || '": ' || s || '}} b"}}'""", """'a {"x": ' || s || '} b'""", """'{"x": ' || s || '}'"""),
    ("""'{"output": [{"content": [{"text": "' || n || '"}, {"text": "{' || s || '}"}]}]}'""", f"n || {BREAK} || '{{' || s || '}}'", "'{' || s || '}'"),
    ("n", "n", "NULL"),
]


@query(told(RESPONSES, "text VARCHAR", "object VARCHAR"))
def service_responses(spark, sf_dir):
    rows = worded(spark, sf_dir, r=column(RESPONSES)).withColumn("text", A.response_text("r"))
    return rows.select("k", "text", A.json_object("text").alias("object"))


# Question; answer, rule.
SOLVED = [
    ("(10 * s) || '% của 200 là bao nhiêu?'", "20 * s", "'percent_of'"), ("'A shirt costs ' || (100 * s) || ' and is discounted by 25%'", "75 * s", "'discounted'"), ("'The number ' || (100 * s) || ' is increased by 10%'", "110 * s", "'increased'"),
    ("'How many roots has 1x^2 + ' || s || 'x + 9 = 0?'", "CASE WHEN s > 6 THEN 2 WHEN s = 6 THEN 1 ELSE 0 END", "'quadratic_roots'"), ("'Solve 2x + ' || s || ' = ' || (3 * s)", "s", "'linear_equation'"),
    ("'In how many ways can you choose 2 people from ' || (s + 2) || '?'", "(s + 2) * (s + 1) // 2", "'combinations'"), ("'There are ' || s || ' ways to choose 1 of them'", "s", "'combinations_inverse'"),
    ("'least common multiple of ' || s || ' and 6'", "lcm(s, 6)", "'least_common_multiple'"), ("'ước chung lớn nhất của ' || s || ' và 18'", "gcd(s, 18)", "'greatest_common_divisor'"), ("'What is the remainder when ' || (s + 17) || ' is divided by 5?'", "(s + 17) % 5", "'remainder'"),
    ("'How many positive divisors does ' || s || ' have?'", "len(list_filter(range(1, s + 1), lambda d: s % d = 0))", "'divisors'"), ("'Find the arithmetic mean of ' || s || ', ' || (s + 3) || ' and ' || (s + 6)", "s + 3", "'mean'"),
    ("'A rectangle has length ' || s || ' and width 3; find its area'", "3 * s", "'rectangle_area'"), ("'chu vi hình chữ nhật dài ' || s || ' rộng 3'", "2 * s + 6", "'rectangle_perimeter'"), ("'diện tích hình vuông cạnh ' || s", "s * s", "'square_area'"),
    ("'the perimeter of a square of side ' || s", "4 * s", "'square_perimeter'"), ("'a triangle has base ' || (2 * s) || ' and height 5; its area?'", "5 * s", "'triangle_area'"), ("'a train at speed ' || s || ' travels for 3 hours'", "3 * s", "'distance'"),
    ("'What is the sum of the first ' || s || ' positive integers?'", "s * (s + 1) // 2", "'sum_to'"), ("'Find the 3rd term of the geometric sequence ' || s || ', ' || (2 * s)", "4 * s", "'geometric_term'"), ("'In the arithmetic sequence ' || s || ', ' || (s + 4) || ' find the 10th term'", "s + 36", "'sequence_term'"),
    ("'căn bậc hai của ' || (s * s)", "s", "'square_root'"), ("'What is ' || (1 + s % 9) || '!?'", "factorial(1 + s % 9)", "'factorial'"), ("'Tính ' || s || ' + 4 * 2'", "s + 8", "'arithmetic'"), ("'One third: tính ' || s || '/3 + 0'", "printf('%.10g', s / 3)", "'arithmetic'"),
    ("n", "NULL", "NULL"), (NOTHING, "NULL", "NULL"),
]


@query(told(SOLVED, "answer VARCHAR", "rule VARCHAR"))
def solver_rules(spark, sf_dir):
    """Every rule of the solver, and plain arithmetic, on questions with the sizes of parts in them."""
    return worded(spark, sf_dir, q=column(SOLVED)).select("k", S.solved("q").alias("a")).select("k", "a.*")


# Question; family by the retrieval audit's rules, by the release audit's.
FAMILIES = [
    ("'cho cấp số cộng có ' || s || ' số hạng'", "'arithmetic_sequence'", "'arithmetic_sequence'"), ("'lan mua ' || s || ' quyển sách và 2 cây bút'", "'books_pens'", "'other'"), ("'lan mua ' || s || ' sách'", "'other'", "'other'"),
    ("'diện tích hình chữ nhật ' || s", "'other'", "'rectangle_area'"), ("'giá sau khi giảm giá ' || s || '%'", "'original_price_discount'", "'percentage'"), ("'xác suất để giỏ hàng ' || n", "'weighted_average_cart'", "'probability'"), ("'giải phương trình ' || s", "'equation'", "'equation'"),
    ("'cáº¥p sá»‘ cá»™ng ' || s", "'arithmetic_sequence'", "'other'"), ("'tổ hợp chập ' || s", "'other'", "'combinatorics'"), ("'còn lại bao nhiêu quả cam? ' || s", "'remainder_oranges'", "'other'"), ("n", "'other'", "'other'"), ("''", "'other'", "'other'"),
]


@query(told(FAMILIES, "audit VARCHAR", "release VARCHAR"))
def template_families(spark, sf_dir):
    return worded(spark, sf_dir, q=column(FAMILIES)).select("k", T.family("q", T.FAMILIES).alias("audit"), T.family("q", T.RELEASE_FAMILIES).alias("release"))


# Question and value; penalty.
PENALTIES = [
    ("'hỏi có bao nhiêu người'", "s * 400.0", "CASE WHEN s > 25 THEN 3 WHEN s > 2.5 THEN 1.5 ELSE 0 END"), ("'xác suất là'", "s / 10.0", "CASE WHEN s > 15 THEN 2.5 ELSE 0 END"), ("'bao nhiêu phần trăm'", "s * 400.0", "CASE WHEN s > 25 THEN 1 ELSE 0 END"),
    ("'tính ' || n", "s * 50000.0", "CASE WHEN s > 20 THEN 4 WHEN s > 2 THEN 1 ELSE 0 END"), ("n", NOTHING, "3"),
]


@query(told(PENALTIES, "penalty DOUBLE", texts=2))
def sanity_penalties(spark, sf_dir):
    rows = worded(spark, sf_dir, q=column(PENALTIES), v=[f"CAST({v} AS DOUBLE)" for v in column(PENALTIES, 1)])
    return rows.select("k", V.sanity_penalty(F.col("q"), F.col("v"), V.SANITY).alias("penalty"))


# Ids; ids without the end marks at their end.
IDS = [("s || ',6,2,2'", "s || ',6'"), ("'2,' || s || ',2,6'", "'2,' || s || ',2,6'"), ("'2,2'", "''"), ("''", "''")]


@query(told(IDS, "left_ids VARCHAR"))
def trailing_ids(spark, sf_dir):
    def ids(text: str) -> Column:
        return F.filter(F.transform(F.split(text, ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())

    rows = worded(spark, sf_dir, t=column(IDS)).select("k", ids("t").alias("ids"))
    return rows.select("k", F.array_join(T.strip_trailing("ids", [2]).cast("array<string>"), ",").alias("left_ids"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag != 'N' THEN l_discount - l_tax END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d IS NULL THEN 'NaN' ELSE printf('%.1f', 100.0 * d) || '%' END AS share, CASE WHEN d IS NULL THEN 'NaN' ELSE printf('%+.3f', d) END AS change, round(sign(d) * log10(1 + abs(d)), 6) AS size FROM v""")
def formatted_measures(spark, sf_dir):
    """Differences of line items as percentages, with signs, and on a signed logarithmic scale."""
    d = F.when(F.col("l_returnflag") != "N", F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", report.percent(d).alias("share"), report.with_sign(d).alias("change"), F.round(report.signed_logarithm(d), 6).alias("size"))


@query(f"""WITH q AS (SELECT k, k % 3 AS form, CASE k % 3 WHEN 0 THEN [s + 100.0, 7] WHEN 1 THEN [s % 5 + 1.0] ELSE [] END AS x, n FROM {SOURCE})
SELECT a.k, b.n AS answer, count(*) AS n FROM q a JOIN q b ON a.form = b.form AND a.x = b.x WHERE b.n IS NOT NULL GROUP BY ALL""")
def template_answers(spark, sf_dir):
    """Names of the parts whose question has the same skeleton and the same numbers."""
    rows = worded(spark, sf_dir, t=["(s + 100) || ' táo và 7 cam'", "'còn ' || (s % 5 + 1) || ' quả'", "'không có số'"])
    asked = rows.select("k", T.skeleton("t").alias("skeleton"), T.query_numbers("t").alias("x"), F.col("n").alias("answer"))
    return retrieval.lookup(asked.drop("answer"), asked, ["skeleton"], "answer", "x").select("k", "answer", "n")
