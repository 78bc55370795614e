"""Text expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms are what lies between these separators after lower-casing; the class is plain enough to mean the same in other engines.
TERM_BREAK = "[^a-z0-9äöüßéèáíóúñ]+"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), strip), "\n")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TERM_BREAK), lambda t: t != "")


def fenced_json(c: Column) -> Column:
    """The object inside a reply: what a code fence holds, else from the first to the last brace."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    brace = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fence != "", fence).when(brace != "", brace)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def human_size(c: Column) -> Column:
    """Bytes as B to PB, two decimals, steps of 1024."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    power = F.when(c < 1024, 0).otherwise(F.least(F.lit(5), F.floor(F.log2(c.cast("double")) / 10)).cast("int"))
    return F.format_string("%.2f %s", c / F.pow(F.lit(1024.0), power), F.element_at(F.array(*map(F.lit, units)), power + 1))
