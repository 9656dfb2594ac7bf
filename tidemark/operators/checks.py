"""Integrity rules as violation tables (rule, id, detail): every violation is a row, nothing stops at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def violations(rows: DataFrame, rule: str, key: Column, bad: Column, detail: Column) -> DataFrame:
    return rows.filter(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), key.cast("string").alias("id"), detail.cast("string").alias("detail"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def orphans(rows: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Rows whose key has no target."""
    return rows.join(targets.select(F.col(target).alias("_t")), F.col(key) == F.col("_t"), "left_anti")


def known(rows: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    return rows.join(targets.select(F.col(target).alias("_t")), F.col(key) == F.col("_t"), "left_semi")


def repeated_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def broken_numbering(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Groups whose numbers, nulls aside, are not 1 to N once each. Counts decide; no group is gathered."""
    sums = rows.filter(F.col(number).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(number).alias("_distinct"), F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    return sums.filter((F.col("_lo") != 1) | (F.col("_hi") != F.col("n")) | (F.col("_distinct") != F.col("n")))


def sentence_end(text: Column, marks: str = "。？！→") -> Column:
    """True where a text that is not blank does not end in one of the marks."""
    return (T.trimmed(text) != "") & ~T.trimmed(text).rlike(f"[{marks}]\\z")


def circled(text: Column) -> Column:
    return text.rlike("[①-⑳]")


def blank(text: Column) -> Column:
    return T.trimmed(F.coalesce(text, F.lit(""))) == ""


def grammar(points: DataFrame, keys: list[str], jp: str, body: str) -> DataFrame:
    """keys, rule, detail: faults of grammar points. jp: an array of example sentences.

    circled: an example still holds a circled mark, one row each; quote: the body holds an empty quotation; lost: no example has any text,
    but the body holds the circled mark of one. A point without examples is no fault.
    """
    own = [F.col(k) for k in keys]
    marked = points.select(*own, F.explode(jp).alias("detail")).filter(circled(F.col("detail"))).select(*own, F.lit("circled").alias("rule"), "detail")
    text = F.coalesce(F.col(body), F.lit(""))
    quote = points.filter(text.contains("「」")).select(*own, F.lit("quote").alias("rule"), text.alias("detail"))
    none = ~F.exists(F.coalesce(F.col(jp), F.array().cast("array<string>")), lambda x: ~blank(x))
    lost = points.filter(none & circled(text)).select(*own, F.lit("lost").alias("rule"), text.alias("detail"))
    return union([marked, quote, lost])
