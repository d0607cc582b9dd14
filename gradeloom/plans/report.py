"""Small tables as text: cells are formatted as columns, and only finished lines reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column
from ..sources.readers import cell_text

#: Rows that a report table may have.
MOST_ROWS = 10_000


def percent(x: Column | str, digits: int = 1) -> Column:
    """A share as a percentage."""
    c = as_column(x)
    return F.when(c.isNull(), "NaN").otherwise(F.format_string(f"%.{digits}f%%", 100.0 * c))


def with_sign(x: Column | str, digits: int = 3) -> Column:
    """A difference, with its sign in any case."""
    c = as_column(x)
    return F.when(c.isNull(), "NaN").otherwise(F.format_string(f"%+.{digits}f", c))


def signed_logarithm(x: Column | str) -> Column:
    """The logarithm of 1 + the magnitude, with the value's sign."""
    c = as_column(x)
    return F.signum(c) * F.log10(1 + F.abs(c))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A pipe table; raises if the table is too long for a report."""
    cells = [F.replace(F.replace(cell_text(F.col(f"`{f.name}`"), f.dataType, digits), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")) for f in df.schema.fields]
    lines = [r.line for r in df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).limit(MOST_ROWS + 1).collect()]
    if len(lines) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*head, *lines]) + "\n"
