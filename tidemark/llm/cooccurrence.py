"""Items that appear together more often than chance.

Baskets are reduced to the items frequent enough to be in any reported pair,
identical baskets are collapsed into one with a weight, and pairs are enumerated
once for each distinct basket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WIDE = "decimal(19,0)"


@dataclass(frozen=True)
class Support:
    """A pair is reported from ``least`` baskets on, if that is at least 1/``one_in`` of all."""

    least: int = 5
    one_in: int = 500
    #: Frequent items up to this number are broadcast; beyond it they are joined by shuffle.
    broadcast_items: int = 100_000


def frequent_pairs(df: DataFrame, basket: str, items: str, clean: Column | None = None, support: Support = Support()) -> DataFrame:
    """Pairs ``a`` < ``b`` with n_ab, n_a, n_b, n, lift and conviction.

    A basket is all rows of one non-null ``basket`` value together; its items
    are the elements of the array ``items`` after ``clean`` (a column over the
    element ``item``), nulls dropped, each once. n counts baskets with at least
    one item. Null and empty arrays add nothing; an empty table has no pairs;
    conviction is null where every basket with a has b.

    An item in fewer baskets than a pair needs cannot be in a pair, so dropping
    it is exact. At most one_in times the mean basket size of items remain, which
    also bounds the arrays that are collected for a basket. Whether the
    remaining ones may be broadcast is decided by counting them.
    """
    slim = df.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.explode(items).alias("item"))
    cleaned = slim.select("basket", (clean if clean is not None else F.col("item")).alias("item")).where(F.col("item").isNotNull())
    single = cut_lineage(cleaned.distinct(), "baskets")
    n = single.agg(F.count_distinct("basket").alias("n")).first().n
    enough = lambda c: (c >= support.least) & (c.cast(WIDE) * support.one_in >= n)
    counts = single.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(enough(F.col("n_item")))
    # from here on items are numbers, so that what is sorted, copied and shuffled is small
    counts = cut_lineage(counts.withColumn("code", F.monotonically_increasing_id()), "items")
    small = counts.count() <= support.broadcast_items
    side = F.broadcast if small else (lambda d: d)
    kept = single.join(side(counts.select(F.col("item").alias("__i"), "code")), F.col("item") == F.col("__i")).select("basket", "code")
    baskets = kept.groupBy("basket").agg(F.array_sort(F.collect_list("code")).alias("items")).where(F.size("items") > 1)
    weighted = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))
    firsts = weighted.select("items", "weight", F.posexplode("items").alias("at", "x"))
    each = firsts.select("x", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("y"), "weight")
    pairs = each.groupBy("x", "y").agg(F.sum("weight").alias("n_ab")).where(enough(F.col("n_ab")))
    of = lambda code, item, count: side(counts.select(F.col("code").alias(code), F.col("item").alias(item), F.col("n_item").alias(count)))
    named = pairs.join(of("x", "item_x", "n_x"), "x").join(of("y", "item_y", "n_y"), "y")
    in_order = F.col("item_x") < F.col("item_y")
    either = lambda one, other: F.when(in_order, F.col(one)).otherwise(F.col(other))
    scored = named.select(
        either("item_x", "item_y").alias("a"),
        either("item_y", "item_x").alias("b"),
        "n_ab",
        either("n_x", "n_y").alias("n_a"),
        either("n_y", "n_x").alias("n_b"),
        F.lit(n).cast("bigint").alias("n"),
    )
    ab, a, b, all_ = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    return scored.select(
        "a",
        "b",
        "n_ab",
        "n_a",
        "n_b",
        "n",
        (ab * all_ / (a * b)).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - b / all_) / (1 - ab / a)).alias("conviction"),
    )


def far_from_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs whose lift is at least ``times``, compared in whole numbers."""
    wide = lambda c: F.col(c).cast(WIDE)
    return pairs.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(times).cast("decimal(3,0)"))
