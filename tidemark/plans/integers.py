"""Queries of the integer-column operators, over the supplier key of line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intcolumn as ic
from tidemark.sources.tables import table

ROW = "CAST(l_orderkey * 8 + l_linenumber AS BIGINT)"


def column(spark: SparkSession, folder: str) -> DataFrame:
    """row, value: the supplier key, missing where the line was returned."""
    items = table(spark, folder, "lineitem")
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), kept.alias("value"))


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """A set of rows: those shipped by large quantities."""
    items = table(spark, folder, "lineitem").where(F.col("l_quantity") >= 40)
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))


_COLUMN = f"""WITH c AS (SELECT {ROW} AS "row", CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS value FROM lineitem),
    m AS (SELECT {ROW} AS "row" FROM lineitem WHERE l_quantity >= 40)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: make(column(spark, folder), marked(spark, folder))
    SQL[name] = f"{_COLUMN} {sql}"


_ALL = 'SELECT "row", value FROM c WHERE '
_add("int_lt", _ALL + "value < 50", lambda c, m: ic.select_rows(c, "value", ic.LT, 50))
_add("int_le", _ALL + "value <= 50", lambda c, m: ic.select_rows(c, "value", ic.LE, 50))
_add("int_eq", _ALL + "value = 50", lambda c, m: ic.select_rows(c, "value", ic.EQ, 50))
_add("int_ge", _ALL + "value >= 50", lambda c, m: ic.select_rows(c, "value", ic.GE, 50))
_add("int_gt", _ALL + "value > 50", lambda c, m: ic.select_rows(c, "value", ic.GT, 50))
_add("int_range", _ALL + "value BETWEEN 45 AND 55", lambda c, m: ic.select_rows(c, "value", ic.RANGE, 45, 55))
_add("int_in", _ALL + "value IN (3, 5, 8)", lambda c, m: ic.in_values(c, "value", [3, 5, 8]))
_add("int_exists", _ALL + "value IS NOT NULL", lambda c, m: ic.with_value(c, "value"))
_add(
    "int_get",
    'SELECT value FROM c WHERE "row" = (SELECT min("row") FROM c WHERE value IS NOT NULL)',
    lambda c, m: ic.value_of(c, "row", ic.with_value(c, "value").agg(F.min("row")).first()[0], "value"),
)
_add("int_within", _ALL + 'value < 50 AND "row" IN (SELECT "row" FROM m)', lambda c, m: ic.select_rows(c, "value", ic.LT, 50, within=m, key="row"))
_add("int_retain", _ALL + '"row" IN (SELECT "row" FROM m)', lambda c, m: ic.retain(c, m, "row"))
_add("int_clear", _ALL + '"row" NOT IN (SELECT "row" FROM m)', lambda c, m: ic.clear(c, m, "row"))
_add("int_set", 'SELECT "row", CASE WHEN "row" IN (SELECT "row" FROM m) THEN 7 ELSE value END AS value FROM c', lambda c, m: ic.set_values(c, m, "row", "value", 7))
_add("int_concat", 'SELECT "row", value FROM c UNION ALL SELECT -"row", value FROM c', lambda c, m: ic.concatenated(c, c.withColumn("row", -F.col("row"))))
_add("int_sum_count", "SELECT CAST(sum(value) AS BIGINT) AS total, count(value) AS n_values FROM c WHERE value BETWEEN 45 AND 55", lambda c, m: ic.sum_and_count(ic.select_rows(c, "value", ic.RANGE, 45, 55), "value"))
_add("int_min_max", 'SELECT min(value) AS least, max(value) AS greatest FROM c WHERE "row" IN (SELECT "row" FROM m)', lambda c, m: ic.min_and_max(ic.retain(c, m, "row"), "value"))
_add("int_min_max_empty", "SELECT min(value) AS least, max(value) AS greatest FROM c WHERE value < -1", lambda c, m: ic.min_and_max(ic.select_rows(c, "value", ic.LT, -1), "value"))
_add("int_avg", "SELECT avg(value) AS mean FROM c", lambda c, m: ic.average(c, "value"))
_add("int_cardinality", "SELECT count(value) AS n_values FROM c", lambda c, m: ic.sum_and_count(c, "value").select("n_values"))
_add("int_distinct", "SELECT DISTINCT value FROM c WHERE value IS NOT NULL", lambda c, m: ic.distinct_values(c, "value"))
_add("int_histogram", "SELECT value, count(*) AS n_rows FROM c WHERE value IS NOT NULL GROUP BY 1", lambda c, m: ic.value_counts(c, "value"))
_add(
    "int_add_columns",
    'SELECT "row", CAST(sum(value) AS BIGINT) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE value < 50) WHERE value IS NOT NULL GROUP BY 1',
    lambda c, m: ic.added(c, ic.select_rows(c, "value", ic.LT, 50), "row", "value"),
)
_add("int_increment_all", 'SELECT "row", value + 1 AS value FROM c', lambda c, m: ic.incremented(c, "row", "value"))
_add("int_increment", 'SELECT "row", value + CASE WHEN "row" IN (SELECT "row" FROM m) THEN 1 ELSE 0 END AS value FROM c', lambda c, m: ic.incremented(c, "row", "value", m))
