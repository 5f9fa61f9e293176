"""Canonical forms of identifiers, type names and hashes as column expressions (all inside code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what a regular expression's \\s stands for; trimming by a set of characters is far cheaper than matching
BLANKS = " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    """Without surrounding white space of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    """Neither null, empty nor blank."""
    return c.isNotNull() & (stripped(c) != "")


def canonical_type(c: Column) -> Column:
    """``HasField``, ``HAS_FIELD``, ``has-field`` and `` has_field `` all become ``has_field``; null stays null.

    Only mixed case and inner separators take the regular expressions.
    """
    text = stripped(c)
    low = F.lower(text)
    parted = F.contains(low, F.lit("__")) | (F.translate(low, "- \t\n\x0b\f\r", "") != low)
    snake = F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s_-]+", "_"))
    return F.when(((text == low) | (text == F.upper(text))) & ~parted, low).otherwise(snake)


def canonical_hex(c: Column) -> Column:
    """One notation of a hexadecimal hash: lower case, without algorithm prefix, 0x, separators or blanks.

    Null and blank hashes become null.
    """
    text = F.lower(stripped(c))
    text = F.regexp_replace(text, r"^[a-z0-9_-]+:(?=[0-9a-f]{16})", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^0x", ""), r"[\s:-]+", "")
    return F.when(text != "", text)
