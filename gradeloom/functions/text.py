"""Column functions for text: normalisation, tokens, numbers, families.

All are JVM expressions but for ``compat``, whose Unicode normal forms and case folding Spark lacks.  Regular
expressions are Unicode-aware throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A numeric literal that is no part of a word, and a LaTeX fraction of two of them.
NUMBER = r"(?<![\w.,])-?\d+(?:[.,]\d+)?(?![\w])"
FRACTION = r"\\(?:d|t)?frac\s*\{\s*(-?\d+(?:[.,]\d+)?)\s*\}\s*\{\s*(-?\d+(?:[.,]\d+)?)\s*\}"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compat(x: Column | str, form: str = "NFKC", fold: bool = False) -> Column:
    """The Unicode normal form ``form`` of a text, case-folded if ``fold``; null stays null.

    A text of ASCII is its own normal form and stays in the JVM; the others go to Python.
    """

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        done = texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")
        return done.str.casefold() if fold else done

    c = as_column(x)
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(apply(other), F.lower(c) if fold else c)


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(as_column(x), r"(?U)\s+", " "))


def text_key(x: Column | str, unicode_forms: bool = True) -> Column:
    """NFKC, lower case, white space squeezed; null counts as empty.

    ``unicode_forms=False`` leaves the normal form alone and stays in the JVM: for text known to be normalised.
    """
    c = F.coalesce(as_column(x), F.lit(""))
    return squeeze(F.lower(compat(c) if unicode_forms else c))


def normalize(x: Column | str, mode: str) -> Column:
    """NFKC and one of ``strip``, ``space``, ``casefold_space``, ``casefold_alnum``."""
    if mode not in ("strip", "space", "casefold_space", "casefold_alnum"):
        raise ValueError(f"unknown mode {mode}")
    c = compat(F.coalesce(as_column(x), F.lit("")), fold=mode.startswith("casefold"))
    if mode == "strip":
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return squeeze(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", " ") if mode == "casefold_alnum" else c)


def alnum_only(x: Column | str) -> Column:
    """Word characters alone."""
    return F.regexp_replace(as_column(x), r"(?U)[^\w]+", "")


def words(x: Column | str, distinct: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(as_column(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(found) if distinct else found


def space_count(x: Column | str) -> Column:
    """Number of parts between white space; 0 for an empty text."""
    c = squeeze(F.coalesce(as_column(x), F.lit("")))
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def numbers(x: Column | str) -> Column:
    """Numeric literals, in order."""
    return F.regexp_extract_all(as_column(x), F.lit(f"(?U){NUMBER}"), F.lit(0))


def mask_numbers(x: Column | str, mask: str = "<NUM>") -> Column:
    return F.regexp_replace(as_column(x), f"(?U){NUMBER}", mask)


def skeleton(x: Column | str) -> Column:
    """A normalised query with fractions and numbers replaced by a mark."""
    c = F.regexp_replace(as_column(x), f"(?U){FRACTION}", " <num> ")
    return squeeze(F.regexp_replace(c, f"(?U){NUMBER}", " <num> "))


def to_number(x: Column | str) -> Column:
    """A literal with point or decimal comma as double; null if it isn't one."""
    return F.replace(as_column(x), F.lit(","), F.lit(".")).try_cast("double")


def query_numbers(x: Column | str) -> Column:
    """Values of fractions first, then of the remaining literals, in order."""
    c = as_column(x)
    tops = F.regexp_extract_all(c, F.lit(f"(?U){FRACTION}"), F.lit(1))
    bottoms = F.regexp_extract_all(c, F.lit(f"(?U){FRACTION}"), F.lit(2))
    fractions = F.zip_with(tops, bottoms, lambda a, b: F.try_divide(to_number(a), to_number(b)))
    rest = F.transform(numbers(F.regexp_replace(c, f"(?U){FRACTION}", " ")), to_number)
    return F.filter(F.concat(fractions, rest), lambda v: v.isNotNull())


def same_numbers(a: Column | str, b: Column | str, tolerance: float = 1e-8) -> Column:
    """Whether two arrays of numbers agree, place by place."""
    a, b = as_column(a), as_column(b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    a, b = as_column(a), as_column(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def stable_fraction(x: Column | str) -> Column:
    """A number in [0, 1) that depends on the value alone: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(as_column(x).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def first_filled(fields: Iterable[str], fallback: Column) -> Column:
    """The first field that isn't blank, marked with its name; else the fallback."""
    return F.coalesce(*(F.when(squeeze(F.coalesce(F.col(f), F.lit(""))) != "", F.concat(F.lit(f"{f}:"), squeeze(F.lower(f)))) for f in fields), fallback)


def query_key(text: Column | str, row_id: Column | str, unicode_forms: bool = True) -> Column:
    """The normalised query, or its id if that is empty."""
    key = text_key(text, unicode_forms)
    return F.when(key != "", key).otherwise(F.concat(F.lit("query_id:"), as_column(row_id).cast("string")))


def family(x: Column | str, rules: list[tuple[str, list[str | tuple[str, ...]]]], other: str = "other") -> Column:
    """The name of the first rule of which a part occurs in the text; of a tuple all must occur."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(rules):
        hit = F.lit(False)
        for part in parts:
            every = F.lit(True)
            for p in (part,) if isinstance(part, str) else part:
                every = every & as_column(x).contains(p)
            hit = hit | every
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))


#: Template families of normalised questions, in order: of the retrieval audit, and of the release audit.
FAMILIES = [
    ("arithmetic_sequence", ["cấp số cộng", "cáº¥p sá»‘ cá»™ng"]), ("set_union", ["thích bóng đá", "thÃ­ch bÃ³ng Ä‘Ã¡"]), ("books_pens", [("lan mua", "cây bút"), ("lan mua", "cÃ¢y bÃºt")]),
    ("free_shipping", ["miễn phí giao hàng", "miá»…n phÃ­ giao hÃ ng"]), ("remainder_oranges", ["quả cam", "quáº£ cam"]), ("weighted_average_cart", ["giỏ hàng", "giá» hÃ ng"]),
    ("original_price_discount", ["sau khi giảm giá", "sau khi giáº£m giÃ¡"]), ("simple_interest_principal", ["lãi đơn", "lÃ£i Ä‘Æ¡n"]), ("isosceles_perimeter", ["tam giác cân", "tam giÃ¡c cÃ¢n"]),
    ("lcm_max", ["bội chung nhỏ nhất", "bá»™i chung nhá» nháº¥t"]), ("floor_ceil", ["floor", "lfloor", "lceil"]), ("probability", ["xác suất", "xÃ¡c suáº¥t"]), ("equation", ["phương trình", "phÆ°Æ¡ng trÃ¬nh"]),
]
RELEASE_FAMILIES = [
    ("arithmetic_sequence", ["cấp số cộng"]), ("geometric_sequence", ["cấp số nhân"]), ("average", ["trung bình cộng"]), ("rectangle_area", [("diện tích", "hình chữ nhật")]), ("rectangle_perimeter", [("chu vi", "hình chữ nhật")]),
    ("percentage", ["phần trăm", "%"]), ("equation", ["phương trình", "giá trị của x"]), ("motion", ["vận tốc", "quãng đường", "thời gian"]), ("probability", ["xác suất"]), ("combinatorics", ["tổ hợp", "hoán vị"]),
]


def strip_trailing(ids: Column | str, ends: list[int]) -> Column:
    """An array of token ids without the run of ``ends`` at its end."""
    a = as_column(ids)
    last = F.array_max(F.transform(a, lambda x, i: F.when(~x.isin(*ends), i)))
    return F.slice(a, 1, F.coalesce(last + 1, F.lit(0)))


def flags(x: Column | str, prefixes: dict[str, str] | None = None) -> dict[str, Column]:
    """Boolean columns of what a text holds, and of the named ``prefixes`` that it starts with."""
    c = F.coalesce(as_column(x), F.lit(""))
    found = {
        "has_latex": c.rlike(r"\\[a-zA-Z]+"), "has_dollar_math": c.rlike(r"\$[^$]+\$"), "has_percent": c.contains("%"),
        "has_money": c.rlike(r"(?iU)(usd|vnd|đồng|\$)"), "has_negative": c.rlike(r"-\d"), "has_fraction": c.rlike(r"\d\s*/\s*\d"),
    }
    return found | {name: c.startswith(prefix) for name, prefix in (prefixes or {}).items()}


def sentences(x: Column | str, also: str = "") -> Column:
    """Parts after . ! ? and white space, or at line breaks (and at any of ``also``); bullets trimmed, blank ones dropped."""
    parts = F.split(as_column(x), rf"(?<=[.!?。])\s+|[\n{also}]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^[ \t•-]+|[ \t•-]+$", "")), lambda s: s != "")


def chunks(x: Column | str) -> Column:
    """Sentences, cut at semicolons as well."""
    return sentences(x, ";")


def digest(x: Column | str) -> Column:
    """SHA-1 of a text: a join key of bounded size."""
    return F.sha1(as_column(x).cast("string").cast("binary"))


def literal_in(answer: Column | str, query: Column | str, most: int = 20) -> Column:
    """Whether a short answer, or its form with the other decimal mark, stands in the query."""
    value = F.replace(F.trim(as_column(answer)), F.lit("$"), F.lit(""))
    q = as_column(query)
    inside = q.contains(value) | q.contains(F.replace(value, F.lit("."), F.lit(","))) | q.contains(F.replace(value, F.lit(","), F.lit(".")))
    return F.coalesce((F.length(value) > 0) & (F.length(value) <= most) & inside, F.lit(False))


def last_sentences(x: Column | str, n: int) -> Column:
    s = sentences(x)
    return F.array_join(F.slice(s, F.greatest(F.size(s) - n + 1, F.lit(1)), n), " ")


def clean_artifacts(x: Column | str) -> Column:
    """Up to four trailing end marks go."""
    return F.regexp_replace(F.rtrim(F.coalesce(as_column(x), F.lit(""))), r"(?:\s*(?:<\|endoftext\|>|</s>|<pad>|hue)){1,4}\s*$", "")


def slug(x: Column | str) -> Column:
    return F.regexp_replace(as_column(x), r"[^A-Za-z0-9_.-]+", "_")


def cap_words(x: Column | str, n: int, tail: bool = False) -> Column:
    """The first (or last) ``n`` parts between white space."""
    parts = F.split(squeeze(as_column(x)), " ")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)) if tail else F.lit(1), F.lit(n)), " ")
