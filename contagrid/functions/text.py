"""Text expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F


def sentence_case(c: Column) -> Column:
    """First letter upper, the rest lower (``initcap`` would touch every word)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def replace_first(c: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.locate(old, c)
    return F.when(
        at > 0,
        F.concat(F.substr(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old))),
    ).otherwise(c)


def replace_all(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Apply (regular expression, new text) rules in order."""
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def strip_commas(c: Column) -> Column:
    return F.translate(c, ",", "")


def parenthesised(c: Column) -> Column:
    """The part from the first '(' to the last ')', brackets included."""
    return F.nullif(F.regexp_extract(c, r"\(.+\)", 0), F.lit(""))


def outcome_label(c: Column) -> Column:
    """Sentence case, except that the territory acronym stays in capitals."""
    return F.regexp_replace(sentence_case(c), "sve", "SVE")


def format_number(c: Column) -> Column:
    """Plain decimal text with at most three decimals and no trailing zeros."""
    text = c.cast("decimal(38,3)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "").alias("text")


def percent_label(c: Column) -> Column:
    return F.concat(format_number(c), F.lit("%"))


def slug(value: str) -> str:
    """Column name for a category: ASCII, lower case, underscores."""
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")
