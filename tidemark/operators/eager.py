"""Eager aggregation through a join, for keys of which a few own most rows.

Joining the rows first would send all rows of a hot key to one task and multiply
them there. Here each input is first reduced to one state a key, in two steps:
by (key, distinct value), which spreads a hot key over all tasks, then by key,
of which each task sends one partial state. The join then meets one row a key on
either side, and what the joined rows would have given follows by algebra:
their count is the product of the counts, a sum over one side is that side's sum
times the other side's count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT = "decimal(19,0)"


def key_states(
    df: DataFrame,
    keys: Sequence[str],
    prefix: str,
    *,
    distinct: str | None = None,
    newest: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """One row a key: ``{prefix}_rows`` and, as asked for, ``_distinct``, ``_newest``, ``_total``.

    Null key parts form keys of their own. ``distinct`` counts the non-null
    values of a column, ``newest`` is its greatest and ``total`` its sum (null
    if all are null). An empty input gives no rows. Other columns are ignored,
    whatever their names.
    """
    parts = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    slim = df.select(
        *parts,
        (F.col(distinct) if distinct else F.lit(None).cast("string")).alias("__d"),
        (F.col(newest) if newest else F.lit(None).cast("bigint")).alias("__m"),
        (F.col(total) if total else F.lit(None).cast("bigint")).alias("__t"),
    )
    first = slim.groupBy(*names, *(["__d"] if distinct else [])).agg(
        F.count(F.lit(1)).alias("__n"),
        *([F.max("__m").alias("__m")] if newest else []),
        *([F.sum("__t").alias("__t")] if total else []),
    )
    wanted = [F.sum("__n").alias(f"{prefix}_rows")]
    if distinct:
        wanted.append(F.count("__d").alias(f"{prefix}_distinct"))
    if newest:
        wanted.append(F.max("__m").alias(f"{prefix}_newest"))
    if total:
        wanted.append(F.sum("__t").alias(f"{prefix}_total"))
    states = first.groupBy(*names).agg(*wanted)
    return states.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *states.columns[len(names) :])


def join_states(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """Join two state tables by key, null-safely, and add ``pair_rows``.

    ``pair_rows`` is the number of rows that joining the original inputs by key
    would give, as DECIMAL(38,0): two hot keys can exceed BIGINT. Counts of a
    side that lacks the key are 0, its other columns null.
    """
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = left.withColumn("__l", F.lit(1)).join(r.withColumn("__r", F.lit(1)), cond, how)
    merged = both.select(
        *[F.when(F.col("__l").isNotNull(), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys],
        *[
            (F.coalesce(F.col(c), F.lit(0)) if c.endswith(("_rows", "_distinct")) else F.col(c)).alias(c)
            for c in [*left.columns, *r.columns]
            if c not in keys and not c.startswith("__r_")
        ],
    )
    counts = [c for c in merged.columns if c.endswith("_rows")]
    return merged.withColumn("pair_rows", F.col(counts[0]).cast(COUNT) * F.col(counts[1]).cast(COUNT))


def roll_up(joined: DataFrame, by: Sequence[str], sums: Sequence[str], maxima: Mapping[str, str] | None = None) -> DataFrame:
    """Combine joined states to coarser keys: sums add, maxima take the greatest."""
    return joined.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(name) for name, c in (maxima or {}).items()]
    )


def heavy_keys(states: DataFrame, rows: DataFrame, count: str, one_in: int) -> DataFrame:
    """The states that hold at least 1/``one_in`` of all ``rows``, compared in integers."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return states.where(F.col(count) * F.lit(one_in) >= total)
