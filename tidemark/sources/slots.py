"""Parquet folders whose rows lie in slots, and are grouped by them without being moved.

Each folder is written once, spread over a fixed number of buckets by one or
more columns, mostly ``__slot``, and sorted within. Read together, the folders
are the partitions of one bucketed table, so that a task gets the same bucket of
all of them: grouping by these columns and whatever else needs no shuffle, nor
does joining by exactly these. The tables are known to the
session's catalog only, under a name of their own, and dropped when the driver
ends; the folders stay.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLOT, FOLDER = "__slot", "__folder"


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its catalog with it
        pass


def write_slots(df: DataFrame, path: str, buckets: int, order: Sequence[str], by: str | None = None, on: Sequence[str] = (SLOT,)) -> None:
    """Write rows, which must be spread by ``repartition(buckets, *on)`` or come from :func:`read_slots`, sorted by ``on`` and ``order`` within a bucket.

    With ``by`` each value of that column goes to a folder of its own, ``path/by=value``.
    """
    name = f"tidemark_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, *on).sortBy(*dict.fromkeys((*on, *order))).option("path", path)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    _drop(df.sparkSession, name)


def read_slots(
    spark: SparkSession, paths: Sequence[str], schema: StructType, buckets: int, order: Sequence[str], on: Sequence[str] = (SLOT,)
) -> DataFrame:
    """All rows of the given folders, which were written with the same ``buckets``, ``order`` and ``on``."""
    name = f"tidemark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placing, sorting = (", ".join(f"`{c}`" for c in some) for some in (on, dict.fromkeys((*on, *order))))
    spark.sql(
        f"CREATE TABLE {name} ({columns}, `{FOLDER}` string) USING parquet PARTITIONED BY (`{FOLDER}`) "
        f"CLUSTERED BY ({placing}) SORTED BY ({sorting}) INTO {buckets} BUCKETS LOCATION '{paths[0]}'"
    )
    atexit.register(_drop, spark, name)
    each = " ".join(f"PARTITION (`{FOLDER}` = '{i}') LOCATION '{path}'" for i, path in enumerate(paths))
    spark.sql(f"ALTER TABLE {name} ADD {each}")
    return spark.table(name).drop(FOLDER)
