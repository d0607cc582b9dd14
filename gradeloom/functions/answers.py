"""Final answers: extraction, numeric parsing, keys and scores."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, cap_words, clean_artifacts, sentences

#: What announces an answer, in order of precedence, and units that end one.
ANCHORS = {
    "dap_an_la": r"đ[áa]p\s*[áa]n\s*l[àa]\s*[:：]?\s*",
    "cau_tra_loi_la": r"c[âa]u\s*tr[ảa]\s*l[ờo]i\s*l[àa]\s*[:：]?\s*",
    "dap_an": r"đ[áa]p\s*[áa]n\s*[:：]\s*",
    "the_answer_is": r"the\s*answer\s*is\s*[:：]?\s*",
    "hash4": r"####\s*",
}
ENGLISH = ("the_answer_is", "hash4")
UNIT_TAIL = r"\s*(đô\s*la|usd|đồng|vnd|cm2?|m2?|km2?|\$|%)\b.*$"
#: Fixed value: a box with one level of braces inside.
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
_COMPILED = {k: re.compile(v, re.IGNORECASE) for k, v in ANCHORS.items()}
_UNIT, _BOX = re.compile(UNIT_TAIL, re.IGNORECASE), re.compile(BOXED)
#: Bounds of the expression parser: nesting, magnitude of results, and of exponents.
MAX_DEPTH, MAX_VALUE, MAX_EXPONENT = 60, 1e300, 4000


def clean_tail(text: str, closers: str = "") -> str:
    """The first line, without trailing punctuation and from a unit on."""
    line = text.strip().partition("\n")[0].strip().rstrip(".,;:。、" + closers)
    return _UNIT.sub("", line).strip()


def find_answer(text: str | None, english: bool = True, first: bool = False, bare: bool = False, closers: str = "") -> tuple[str | None, str | None]:
    """(answer, anchor): after the anchor match that ends last, else in the last box, else (``bare``) the last number.

    ``first``: the first match of the first anchor that occurs, the older rule.
    """
    if not text:
        return None, None
    names = [n for n in ANCHORS if english or n not in ENGLISH]
    ends = [(m.end(), -i, name) for i, name in enumerate(names) for m in _COMPILED[name].finditer(text)]
    if ends:
        end, _, name = min(ends, key=lambda e: (-e[1], e[0])) if first else max(ends)
        return clean_tail(text[end:], closers), name
    if boxes := _BOX.findall(text):
        return clean_tail(boxes[-1], closers), "boxed"
    if bare and (found := re.findall(r"-?\d+(?:[.,]\d+)?", text)):
        return found[-1], "bare"
    return None, None


class _Parser:
    """Recursive descent over + - * / // ^ sqrt pi numbers and parentheses, in bounded depth and magnitude."""

    TOKEN = re.compile(r"(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>sqrt|pi)|(?P<op>\*\*|//|[-+*/^()])")

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m:
                raise ValueError(text[at])
            kind = m.lastgroup
            if kind == "num" and re.fullmatch(r"0\d*[1-9]\d*", m.group()):
                raise ValueError("leading zero")
            self.tokens.append((kind, "^" if m.group() == "**" else m.group()))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (what is not None and self.tokens[self.at][1] != what):
            raise ValueError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def bounded(self, x: float) -> float:
        if isinstance(x, complex) or not abs(x) <= MAX_VALUE:
            raise ValueError("out of bounds")
        return x

    def sum(self, depth: int) -> float:
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        x = self.product(depth)
        while self.peek() in ("+", "-"):
            x = self.bounded(x + self.product(depth) if self.take()[1] == "+" else x - self.product(depth))
        return x

    def product(self, depth: int) -> float:
        x = self.signed(depth)
        while self.peek() in ("*", "/", "//"):
            op, y = self.take()[1], self.signed(depth)
            x = self.bounded(x * y if op == "*" else x / y if op == "/" else x // y)
        return x

    def signed(self, depth: int) -> float:
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take()[1] == "-" else sign
        return sign * self.power(depth)

    def power(self, depth: int) -> float:
        base = self.atom(depth)
        if self.peek() != "^":
            return base
        self.take()
        exponent = self.signed(depth + 1)
        if depth > MAX_DEPTH or abs(exponent) > MAX_EXPONENT or (base and abs(exponent) * math.log10(max(abs(base), 1 / abs(base))) > 308 and exponent * math.log10(abs(base)) > 0):
            raise ValueError("out of bounds")
        return self.bounded(base**exponent)

    def atom(self, depth: int) -> float:
        kind, value = self.take()
        if kind == "num":
            return float(value) if re.search(r"[.eE]", value) else int(value) if len(value) < 300 else self.bounded(float("inf"))
        if value == "pi":
            return math.pi
        if value == "sqrt":
            self.take("(")
        elif value != "(":
            raise ValueError(value)
        x = self.sum(depth + 1)
        self.take(")")
        return math.sqrt(x) if value == "sqrt" else x


def evaluate(expression: str) -> float | None:
    """The finite value of an expression, or None."""
    try:
        parser = _Parser(expression)
        x = float(parser.sum(0))
        return x if parser.peek() is None and math.isfinite(x) else None
    except (ValueError, ArithmeticError, RecursionError, TypeError):
        return None


#: LaTeX rewritten before parsing, as (pattern, replacement), in order.
LATEX = [
    (r"\\text\{[^}]*\}", ""), (r"\\mathrm\{[^}]*\}", ""), (r"\$", ""),
    (r"\\,|\\!|\;|\\ |\\left|\\right", ""), (r"\\cdot|\\times", "*"),
    (r"\\(?:d|t)?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"((\1)/(\2))"),
    (r"\\sqrt\s*\{([^{}]+)\}", r"sqrt(\1)"), (r"\\sqrt\s*(\d+(?:\.\d+)?)", r"sqrt(\1)"), (r"\\pi", "pi"),
    (r"(\d)\s*(sqrt|pi|\()", r"\1*\2"), (r"(\))\s*(sqrt|pi|\d)", r"\1*\2"), (r"(pi)\s*(sqrt|pi|\d|\()", r"\1*\2"),
]
_LATEX = [(re.compile(a), b) for a, b in LATEX]
_WRAPPED = re.compile(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}")


def parse_number(text: str | None) -> float | None:
    """A finite scalar: plain or scientific, decimal comma, an assignment's right side, LaTeX; never a tuple or symbol."""
    s = (text or "").strip()
    if re.fullmatch(r"-?\d+,\d+", s):
        return float(s.replace(",", "."))
    if re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", s):
        return x if math.isfinite(x := float(s)) else None
    if m := re.match(r"[A-Za-z_]\w*\s*=\s*(.+)$", s):
        s = m[1].strip()
    pair = s[:1] == "(" and s[-1:] == ")" and re.search(r"\d\s*,\s*\d", s)
    if not s or pair or (s[0] == "[" and s[-1] == "]"):
        return None
    for _ in range(3):
        s = _WRAPPED.sub(r"(\1)", s)
    for pattern, by in _LATEX:
        s = pattern.sub(by, s)
    if s.count(",") == 1 and "." not in s and re.search(r"\d,\d", s):
        s = re.sub(r"(?<=\d),(?=\d)", ".", s)
    else:
        s = re.sub(r"(?<=\d),(?=\d{3}\b)", "", s)
    return evaluate(re.sub(r"\s+", "", s))


def number_key(value: float | None, digits: int = 10) -> str | None:
    """The integer nearest by 1e-9 as text, else ``digits`` significant digits."""
    if value is None or not math.isfinite(value):
        return None
    return str(round(value)) if abs(value - round(value)) < 1e-9 else f"{value:.{digits}g}"


def extracted(x: Column | str, **rules: object) -> Column:
    """struct(answer, anchor, num) of a text, parsed once."""

    @F.pandas_udf("answer string, anchor string, num double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        found = [find_answer(t, **rules) for t in texts]
        return pd.DataFrame({"answer": [a for a, _ in found], "anchor": [n for _, n in found], "num": pd.Series([parse_number(a) for a, _ in found], dtype="float64")})

    return apply(as_column(x))


def parsed(x: Column | str) -> Column:
    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_number(t) for t in texts], dtype="float64")

    return apply(as_column(x))


def keyed(x: Column | str, digits: int = 10) -> Column:
    """``number_key`` of a double column; 6 digits give canonical answers."""

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else number_key(float(v), digits) for v in values], dtype="object")

    return apply(as_column(x))


def sanitized(x: Column | str, lead: str = "Đáp án là: ") -> Column:
    """The canonical answer line of a text whose answer is a number, else its cleaned text."""
    c = clean_artifacts(x)
    key = keyed(extracted(c)["num"], 6)
    return F.when(key.isNotNull(), F.concat(F.lit(lead), key)).otherwise(c)


def simple_number(x: Column | str) -> Column:
    """The loose rule: commas dropped, the first numeric substring."""
    found = F.regexp_extract(F.replace(F.coalesce(as_column(x), F.lit("")), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def answer_form(x: Column | str, num: Column | str) -> Column:
    """The written form of an answer."""
    a, sign = F.trim(as_column(x)), F.when(F.trim(as_column(x)).startswith("-"), "negative_").otherwise("")
    body = F.regexp_replace(a, "^-", "")
    form = F.when(body.rlike(r"^\d+$"), "integer").when(body.rlike(r"^\d+,\d+$"), "decimal_comma").when(body.rlike(r"^\d+\.\d+$"), "decimal_dot").when(body.rlike(r"^\d+(\.\d+)?[eE][+-]?\d+$"), "scientific").otherwise("numeric_other")
    return F.when(a.isNull() | (a == ""), "missing").when(as_column(num).isNull(), "non_numeric").otherwise(F.concat(sign, form))


def rel_error(pred: Column | str, gold: Column | str) -> Column:
    """Relative to the gold's magnitude, 1 at least; null if either is."""
    p, g = as_column(pred), as_column(gold)
    return F.when(p.isNotNull() & g.isNotNull(), F.abs(p - g) / F.greatest(F.lit(1.0), F.abs(g)))


#: The score for each largest relative error.
TIERS = ((0.01, 10), (0.10, 5), (0.50, 1))


def score(err: Column | str, extractable: Column | bool = True) -> Column:
    e, out = as_column(err), F.lit(0)
    for limit, points in reversed(TIERS):
        out = F.when(e <= limit, points).otherwise(out)
    return F.when(e.isNull() | ~(F.lit(extractable) if isinstance(extractable, bool) else extractable), 0).otherwise(out).cast("int")


def close(a: Column | str, b: Column | str, relative: bool = True, tolerance: float = 1e-9) -> Column:
    """Equal but for 1e-9, relative to the larger magnitude (1 at least) or absolute; false if either is null."""
    x, y = as_column(a), as_column(b)
    most = F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) if relative else F.lit(1.0)
    return F.coalesce(F.abs(x - y) <= tolerance * most, F.lit(False))


def equations(x: Column | str) -> Column:
    """Distinct runs of at least three mathematical tokens that hold a digit and an operator, in order."""
    runs = F.regexp_extract_all(F.coalesce(as_column(x), F.lit("")), F.lit(r"[0-9(][0-9().,\s+\-*/=×÷^%]*[0-9)]"), F.lit(0))
    tidy = F.transform(runs, lambda r: F.lower(F.trim(F.regexp_replace(r, r"\s+", " "))))
    return F.array_distinct(F.filter(tidy, lambda r: (F.length(r) >= 5) & r.rlike(r"[-+*/=×÷^]") & r.rlike(r"\d")))


def number_from_key(key: Column | str) -> Column:
    """The number that a key tells, null if none."""
    return as_column(key).try_cast("double")


def arithmetic_values(nums: Column | str, most: int = 6, cap: int | None = None) -> Column:
    """Values that simple arithmetic makes of a query's numbers: those of different keys, in order, ``cap`` at most.

    The numbers, their sum, first and last less each other, and the product of two to four; none for more than ``most``.
    """
    n = as_column(nums)
    size, first, last = F.size(n), F.get(n, F.lit(0)), F.element_at(n, -1)
    total = F.aggregate(n, F.lit(0.0), lambda a, v: a + v)
    product = F.aggregate(n, F.lit(1.0), lambda a, v: a * v)
    more = F.when(size >= 2, F.array(first - last, last - first)).otherwise(F.array().cast("array<double>"))
    times = F.when((size > 1) & (size <= 4), F.array(product)).otherwise(F.array().cast("array<double>"))
    every = F.when((size == 0) | (size > most), F.array().cast("array<double>")).otherwise(F.concat(n, F.array(total), more, times))
    # Values whose keys are equal differ by less than their tenth digit: compared as rounded texts.
    key = lambda v: F.when(F.abs(v - F.rint(v)) < 1e-9, F.rint(v) + 0.0).otherwise(F.format_string("%.9e", v).cast("double"))
    different = F.aggregate(every, F.array().cast("array<double>"), lambda a, v: F.when(F.array_contains(F.transform(a, key), key(v)), a).otherwise(F.concat(a, F.array(v))))
    return different if cap is None else F.slice(different, 1, cap)


def json_object(x: Column | str) -> Column:
    """The text from the first { to the last }."""
    return F.nullif(F.regexp_extract(as_column(x), r"(?s)\{.*\}", 0), F.lit(""))


def response_text(x: Column | str) -> Column:
    """The text of a service's JSON response: ``output_text``, else all text of its output's contents, else as it is."""
    c = as_column(x)
    parts = F.from_json(F.get_json_object(c, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    texts = F.flatten(F.transform(parts, lambda p: F.coalesce(p["content"]["text"], F.array().cast("array<string>"))))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")
    return F.coalesce(F.nullif(F.get_json_object(c, "$.output_text"), F.lit("")), F.nullif(joined, F.lit("")), c)


#: The line that tells an answer, what a prompt says, and an answer's tail with all that follows it.
ANSWER_LINE, QUESTION_LINE = "Đáp án là: ", "Câu hỏi: "
TAIL = r"(?:đ[áa]p\s*[áa]n\s*l[àa]\s*[:：]?|c[âa]u\s*tr[ảa]\s*l[ờo]i\s*l[àa]\s*[:：]?|####)"


def answer_target(canonical: Column | str) -> Column:
    """The training target that tells the answer alone."""
    return F.concat(F.lit(ANSWER_LINE), as_column(canonical).cast("string"))


def answer_item(key: Column | str, fallback: Column | str) -> Column:
    """The output line of an answer key, else the fallback output, else nothing."""
    return F.coalesce(answer_target(key), as_column(fallback), F.lit(""))


def prompt(query: Column | str, template: str = QUESTION_LINE + "{q}\n") -> Column:
    """A template with the trimmed query in the place of ``{q}``."""
    head, _, tail = template.partition("{q}")
    return F.concat(F.lit(head), F.trim(F.coalesce(as_column(query), F.lit(""))), F.lit(tail))


def prompt_with_examples(query: Column | str, kind: Column | str, examples: dict[str, str], template: str = QUESTION_LINE + "{q}\n") -> Column:
    """The prompt behind the worked examples of the query's kind, if there are any."""
    shots = F.lit("")
    for name, text in examples.items():
        shots = F.when(as_column(kind) == name, F.lit(text)).otherwise(shots)
    return F.concat(shots, prompt(query, template))


def unboxed(x: Column | str) -> Column:
    """Boxes replaced by what they hold."""
    return F.regexp_replace(as_column(x), r"\\boxed\{([^{}]+)\}", "$1")


def without_tail(x: Column | str) -> Column:
    """A solution up to its last anchor, unboxed, in one line; without an anchor all of it."""
    c = F.coalesce(as_column(x), F.lit(""))
    body = F.regexp_replace(c, rf"(?isu){TAIL}(?!.*{TAIL}).*$", "")
    return F.trim(F.regexp_replace(unboxed(body), r"(?U)\s+", " "))


def compact_reasoning(x: Column | str, most_words: int = 96) -> Column:
    """The last two sentences with an equation of the last six, else the last two with a digit, else the last two."""
    body = without_tail(x)
    tail = F.slice(sentences(body), F.greatest(F.size(sentences(body)) - 5, F.lit(1)), 6)
    digits = F.filter(tail, lambda s: s.rlike("[0-9]"))
    sums = F.filter(digits, lambda s: s.rlike(r"[+\-*/=×÷^]|\\\\frac|\\\\sqrt"))
    two = lambda a: F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), 2)
    return cap_words(F.array_join(F.when(F.size(sums) > 0, two(sums)).when(F.size(digits) > 0, two(digits)).otherwise(two(tail)), " "), most_words, tail=True)


def normalized_response(x: Column | str, canonical: Column | str) -> Column:
    """A response without its trailing anchors, and one canonical answer line behind it."""
    body = F.regexp_replace(F.rtrim(F.coalesce(as_column(x), F.lit(""))), rf"(?isu)(?:\s*{TAIL}[^\n]*)+\s*$", "")
    return F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n"), F.coalesce(answer_target(canonical), F.lit(ANSWER_LINE)))


#: Phrases that mark a question with distracting facts.
MARKERS = (" x ", " x%", " n ", " bien ", " gia tri ", " khong lien quan ", " neu ", " nhung ")


def distractor_score(query: Column | str) -> Column:
    """Points for many numbers, many words, percent or money, unknowns, and a marking phrase, of a normalised query."""
    q = as_column(query)
    n, w = F.regexp_count(q, F.lit(r"[-+]?[0-9]+(?:[.,][0-9]+)?")), F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?U)\w+"), F.lit(0)))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.concat(F.lit(" "), q, F.lit(" ")).contains(m)
    points = (n >= 4, n >= 6, F.size(w) >= 55, q.contains("%") | q.contains("$"), F.array_contains(w, "x") | F.array_contains(w, "n"), marked)
    return F.coalesce(sum((p.cast("int") for p in points[1:]), points[0].cast("int")), F.lit(0))


def output_shape(x: Column | str, equation_prefix: str, answer_prefix: str, anchor: str) -> Column:
    """struct(shape, equals): how an output begins, and the equality signs before its first anchor."""
    t = F.trim(F.coalesce(as_column(x), F.lit("")))
    shape = F.when(t.startswith(equation_prefix), "equation_plus_answer").when(t.startswith(answer_prefix), "answer_only").when(t.contains(anchor), "other_with_answer_anchor").otherwise("no_answer_anchor")
    before = F.substring_index(t, anchor, 1)
    return F.struct(shape.alias("shape"), (F.length(before) - F.length(F.replace(before, F.lit("="), F.lit("")))).alias("equals"))


#: Fixed value: the anchor of a final answer.
FINAL_ANCHOR = r"đ[áa]p\s*[áa]n\s*l[àa]\s*[:：]?"


def anchor_layout(x: Column | str) -> Column:
    """struct(anchors, answer_first, reason_chars, tail_chars) of a text: what stands before and behind its last anchor."""
    c = clean_artifacts(x)
    n = F.regexp_count(c, F.lit(f"(?iu){FINAL_ANCHOR}"))
    before = F.regexp_replace(c, rf"(?isu){FINAL_ANCHOR}(?!.*{FINAL_ANCHOR}).*$", "")
    after = F.regexp_replace(c, rf"(?isu)^.*{FINAL_ANCHOR}", "")
    chars = lambda t: F.when(n > 0, F.length(F.trim(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))).otherwise(0)
    first = F.coalesce(c.rlike(rf"(?isu)^.{{0,2}}{FINAL_ANCHOR}"), F.lit(False))
    return F.struct(n.alias("anchors"), first.alias("answer_first"), chars(before).alias("reason_chars"), chars(after).alias("tail_chars"))


def has_equation(x: Column | str) -> Column:
    """Whether a text holds a digit and an operator."""
    return as_column(x).rlike("[0-9]") & as_column(x).rlike(r"[+\-*/=^]|\\\\frac|\\\\sqrt")


def reward(points: Column, extractable: Column, equation: Column, tokens: Column) -> Column:
    """The plain reward: a tenth of the score, an answer, few tokens and an equation; within 0 and 1.2."""
    value = points / 10.0 + F.when(extractable, 0.15).otherwise(-0.20) + F.when(tokens <= 64, 0.05).when(tokens > 96, -0.05).otherwise(0.0) + F.when(equation, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.2), value))


def layout_reward(points: Column, final: Column, answer_first: Column, reason_chars: Column, equation: Column, several: Column, tokens: Column) -> Column:
    """The reward that looks at the layout: the reasons stand before one final anchor; within 0 and 1.4."""
    value = points / 10.0 + F.when(final, 0.20).otherwise(-0.30) + F.when(answer_first, -0.35).otherwise(0.10) + F.when(reason_chars >= 24, 0.15).otherwise(-0.15)
    value = value + F.when(equation, 0.10).otherwise(0.0) + F.when(several, -0.10).otherwise(0.0) + F.when(tokens.between(32, 96), 0.05).when((tokens < 12) | (tokens > 128), -0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.4), value))
