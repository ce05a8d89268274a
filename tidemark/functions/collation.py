"""Texts compared as a reader does: by Unicode's collation, so that equality, joins, groups and order agree on case and accents.

Lower-casing tells a composed letter from the same one with a combining mark, and sorts by
code point.  Under UNICODE_CI both forms are one letter, case is nothing and accents count;
under UNICODE_CI_AI accents are nothing either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME = "UNICODE_CI"
#: Digits to which numbers in text are padded for their order.
DIGITS = 12


def collated(x: Column, collation: str = SAME) -> Column:
    return F.collate(x, collation)


def plain(x: Column) -> Column:
    """A collated text as an ordinary one, which files and other engines take."""
    return F.collate(x, "UTF8_BINARY")


def natural(x: Column, collation: str = SAME) -> Column:
    """An order of texts by collation in which numbers count by their value: leading zeros go, digits are padded."""
    parts = F.regexp_extract_all(x, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), DIGITS, "0")).otherwise(p))
    return collated(F.array_join(padded, ""), collation)


def one_spelling(rows: DataFrame, keys: Sequence[str], text: str, collation: str = SAME) -> DataFrame:
    """(keys, text, n): each text once among the equal ones of its keys, in the spelling that is commonest, and of these the first by code point.

    Rows without a text are nobody's.  Spellings are counted before they meet.
    """
    counted = rows.where(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.count("*").alias("_n"))
    met = counted.groupBy(*keys, collated(F.col(text), collation).alias("_same"))
    return met.agg(F.min_by(F.col(text), F.struct(-F.col("_n"), F.col(text))).alias(text), F.sum("_n").alias("n")).select(*keys, text, "n")


def semi_join(rows: DataFrame, wanted: DataFrame, text: str, collation: str = SAME) -> DataFrame:
    """Rows whose text is among the wanted ones."""
    asked = wanted.select(collated(F.col(text), collation).alias("_w"))
    return rows.join(asked, collated(F.col(text), collation) == F.col("_w"), "left_semi")
