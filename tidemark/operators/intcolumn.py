"""Predicates, aggregates and arithmetic on an integer column with missing values.

A column is a DataFrame with a row key and a nullable BIGINT; a row has a value
if it is not null. Comparisons are signed, and aggregates over nothing are null.
Null keys match no key of a set and so are never in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LT, LE, EQ, GE, GT, RANGE = "LT", "LE", "EQ", "GE", "GT", "RANGE"


def compares(value: Column, op: str, bound: int, end: int | None = None) -> Column:
    """The predicate ``value op bound``; for RANGE both ends are included. Null values pass none."""
    if op == RANGE:
        if end is None:
            raise ValueError("RANGE needs an end")
        return value.between(bound, end)
    tests = {LT: Column.__lt__, LE: Column.__le__, EQ: Column.__eq__, GE: Column.__ge__, GT: Column.__gt__}
    if op not in tests:
        raise ValueError(f"no comparison {op!r}")
    return tests[op](value, F.lit(bound))


def select_rows(df: DataFrame, value: str, op: str, bound: int, end: int | None = None, within: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows that pass the comparison, if given only those ``within`` an earlier result (by ``key``)."""
    found = df.where(compares(F.col(value), op, bound, end))
    return found if within is None else retain(found, within, key)


def in_values(df: DataFrame, value: str, values: Sequence[int]) -> DataFrame:
    return df.where(F.col(value).isin(list(values))) if values else df.where(F.lit(False))


def with_value(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull())


def value_of(df: DataFrame, key: str, row: int, value: str) -> DataFrame:
    return df.where((F.col(key) == row) & F.col(value).isNotNull()).select(value)


def _keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("__key"))


def retain(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``rows``."""
    return df.join(_keys(rows, key), F.col(key) == F.col("__key"), "left_semi")


def clear(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``rows``."""
    return df.join(_keys(rows, key), F.col(key) == F.col("__key"), "left_anti")


def set_values(df: DataFrame, rows: DataFrame, key: str, value: str, to: int) -> DataFrame:
    """``key`` and ``value`` with ``to`` in all rows whose key is in ``rows``; keys that no row has are added once."""
    marks = _keys(rows, key).where(F.col("__key").isNotNull()).distinct()
    fixed = F.lit(to).cast("bigint")
    own = df.select(F.col(key), F.col(value).cast("bigint").alias(value))
    changed = own.join(marks, F.col(key) == F.col("__key"), "left").select(
        key, F.when(F.col("__key").isNotNull(), fixed).otherwise(F.col(value)).alias(value)
    )
    missing = marks.join(own.select(F.col(key).alias("__own")), F.col("__key") == F.col("__own"), "left_anti")
    return changed.unionByName(missing.select(F.col("__key").alias(key), fixed.alias(value)))


def concatenated(*columns: DataFrame) -> DataFrame:
    """Columns over disjoint row keys as one."""
    out = columns[0]
    for more in columns[1:]:
        out = out.unionByName(more)
    return out


def sum_and_count(df: DataFrame, value: str) -> DataFrame:
    """One row: total (null if nothing has a value), n_values."""
    return df.agg(F.sum(value).cast("bigint").alias("total"), F.count(value).alias("n_values"))


def min_and_max(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("least"), F.max(value).alias("greatest"))


def average(df: DataFrame, value: str) -> DataFrame:
    return df.agg((F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))).alias("mean"))


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    return with_value(df, value).select(value).distinct()


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Each value and how many rows have it; partial counts meet in the shuffle, so a common value is no burden."""
    return with_value(df, value).groupBy(value).agg(F.count(F.lit(1)).alias("n_rows"))


def added(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Row-wise sum; a row missing on one side counts 0 there, and one without a value on either is left out.

    A union and one grouping instead of a full join: rows are reduced before the shuffle.
    """
    both = with_value(left, value).select(key, value).unionByName(with_value(right, value).select(key, value))
    return both.groupBy(key).agg(F.sum(value).cast("bigint").alias(value))


def incremented(df: DataFrame, key: str, value: str, rows: DataFrame | None = None, by: int = 1) -> DataFrame:
    """``value`` plus ``by``, in all rows or those whose key is in ``rows``; missing values stay missing."""
    if rows is None:
        return df.withColumn(value, F.col(value) + by)
    marks = _keys(rows, key).distinct()
    joined = df.join(marks, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(value, F.when(F.col("__key").isNotNull(), F.col(value) + by).otherwise(F.col(value))).drop("__key")
