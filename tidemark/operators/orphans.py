"""References to records that do not exist, followed down the foreign-key graph.

A record is a direct orphan if the key it refers to is held by no record of the
parent table. Where all records of a key are orphans, the key is gone, and
records that refer to it are indirectly orphaned; that cascade is iterated to a
fixpoint, each round semi-joining only the keys that went in the round before,
and only along references whose parent lost some. The rounds are at most as many
as the longest chain of references has links, and none where the graph itself
shows that nothing can be handed down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, scratch_path, width_for
from tidemark.sources.slots import read_slots, write_slots

IDENTITY = ("ref_table", "ref_month", "id", "parent", "refs")
RESULT = "ref_table string, ref_month string, id string, parent string, kind string, round int"


@dataclass(frozen=True)
class Reference:
    """Column ``via`` of ``child`` holds keys of ``parent``."""

    child: str
    via: str
    parent: str


def find_orphans(tables: Mapping[str, DataFrame], references: Sequence[Reference], key: str = "id", period: str = "period") -> DataFrame:
    """Orphans of all tables: ref_table, ref_month, id, parent, kind, round.

    Each table gives its standing records with columns ``key``, ``period`` and
    those that references name; others are ignored. ``kind`` is ``direct`` or
    ``inherited``, ``round`` the length of the cascade. A null reference points
    at nothing and is no orphan; a record with a null key can be an orphan but
    not a parent. Repeated records count once. An empty parent table makes all
    references to it orphans; an empty child table has none.

    Records are reduced to distinct (key, period, references) before any join,
    so that a key repeated millions of times meets the join once; these are
    written to the shared folder, as every reference and round reads them.
    Tables that refer by their own key are laid out by it, so that comparing two
    of them moves no row. Each round ends in a written table; ``round`` reports
    how many there were.
    """
    spark = next(iter(tables.values())).sparkSession
    via = {t: sorted({r.via for r in references if r.child == t} | {key}) for t in tables}
    buckets = max(map(width_for, tables.values()))
    nodes = {t: _nodes(df, t, via[t], key, period, buckets) for t, df in tables.items()}

    def as_found(df: DataFrame, ref: Reference, kind: str, number: int) -> DataFrame:
        return df.select(
            F.lit(ref.child).alias("ref_table"),
            F.col("__period").alias("ref_month"),
            F.col(key).alias("id"),
            F.lit(ref.parent).alias("parent"),
            F.lit(kind).alias("kind"),
            F.lit(number).alias("round"),
            _refers(via[ref.child], key).alias("refs"),
        )

    def keyed(df: DataFrame) -> DataFrame:
        return df.where(F.col("__key").isNotNull()).distinct()

    def missing(ref: Reference) -> DataFrame:
        held = keyed(nodes[ref.parent].select(F.col(key).alias("__key")))
        children = nodes[ref.child].where(F.col(ref.via).isNotNull())
        return children.join(held, F.col(ref.via) == F.col("__key"), "left_anti")

    if not references:
        return spark.createDataFrame([], RESULT)
    found = reduce(DataFrame.unionByName, [as_found(missing(r), r, "direct", 0) for r in references])
    if not any(_hands_down(upper, lower, key) for upper in references for lower in references):
        return found.drop("refs").distinct()
    found = cut_lineage(found, "orphans")
    rounds, fresh = [found], found
    while True:
        number = len(rounds)
        so_far = reduce(DataFrame.unionByName, rounds)
        lost = {r[0] for r in fresh.select("ref_table").distinct().collect()}  # names of tables
        steps = []
        for ref in references:
            if ref.parent not in lost:
                continue
            gone = keyed(_gone(fresh, so_far, ref.parent, nodes[ref.parent], via[ref.parent], key))
            hit = nodes[ref.child].join(gone, F.col(ref.via) == F.col("__key"), "left_semi")
            steps.append(as_found(hit, ref, "inherited", number))
        if not steps:
            return so_far.drop("refs").distinct()
        known = so_far.select(*[F.col(c).alias(f"__{c}") for c in IDENTITY])
        fresh = cut_lineage(
            reduce(DataFrame.unionByName, steps)
            .distinct()
            .join(
                known,
                reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]),
                "left_anti",
            ),
            "orphans",
        )
        if fresh.isEmpty():
            return so_far.drop("refs").distinct()
        rounds.append(fresh)


def _nodes(df: DataFrame, name: str, via: Sequence[str], key: str, period: str, buckets: int) -> DataFrame:
    """Distinct records, written: in buckets by their key if that is all they refer by, as records of one key are then few."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"nodes-{name}")
    slim = df.select(*[F.col(c) for c in via], F.col(period).alias("__period")).distinct()
    if set(via) > {key}:
        slim.write.parquet(path)
        return spark.read.schema(slim.schema).parquet(path)
    # a null key is no parent here, and no reference
    placed = slim.where(F.col(key).isNotNull()).repartition(buckets, key)
    write_slots(placed, path, buckets, (), on=[key])
    return read_slots(spark, [path], placed.schema, buckets, (), on=[key])


def _hands_down(upper: Reference, lower: Reference, key: str) -> bool:
    """Whether orphans by ``upper`` can take children by ``lower`` along.

    They are the parents there; but where two tables refer to each other by
    their own keys, what is missing on one side is so because the other has none.
    """
    mirrored = upper.parent == lower.child and upper.via == lower.via == key
    return upper.child == lower.parent and not mirrored


def _refers(via: Sequence[str], key: str) -> Column:
    """What tells records of one key apart: the values they refer by, or null if that is the key itself."""
    if set(via) <= {key}:
        return F.lit(None).cast("array<string>")
    return F.array(*[F.col(c).cast("string") for c in via])


def _gone(fresh: DataFrame, so_far: DataFrame, table: str, nodes: DataFrame, via: Sequence[str], key: str) -> DataFrame:
    """Keys of ``table`` that became orphaned just now and that no record outside ``so_far`` holds."""
    keys = fresh.where(F.col("ref_table") == table).select(F.col("id").alias("__key"))
    if set(via) <= {key}:  # records of one key refer alike, so all of them are orphans
        return keys
    lost = so_far.where(F.col("ref_table") == table).select(F.col("ref_month").alias("__month"), F.col("refs").alias("__refs")).distinct()
    alike = F.col("__period").eqNullSafe(F.col("__month")) & _refers(via, key).eqNullSafe(F.col("__refs"))
    kept = nodes.join(lost, alike, "left_anti")
    return keys.join(kept.select(F.col(key).alias("__kept")), F.col("__key") == F.col("__kept"), "left_anti")
