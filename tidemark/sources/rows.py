"""Stored rows, their payload codec and placement, and files of dump rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import DUMP
from tidemark.session import use_utc
from tidemark.sources.yson import read_fragments

PAYLOAD = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("sev", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]
)
BROKEN = "_corrupt_record"
SHARDS = 1024


def decoded(payload: Column, schema: T.StructType = PAYLOAD) -> Column:
    """The struct in a payload of UTF-8 JSON; null for a null, cut-off or otherwise broken one, never half of it."""
    text = F.try_validate_utf8(payload.cast("string"))
    read = F.from_json(text, T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]), {"columnNameOfCorruptRecord": BROKEN})
    whole = F.struct(*[read[f.name].alias(f.name) for f in schema])
    return F.when(text.isNotNull() & read[BROKEN].isNull() & text.rlike(r"\A\s*\{"), whole)


def encoded(payload: Column) -> Column:
    """A struct as UTF-8 JSON, null fields included; null for null."""
    return F.encode(F.to_json(payload, {"ignoreNullFields": "false"}), "UTF-8")


def shard(*keys: Column, shards: int = SHARDS) -> Column:
    """The shard of a key, from 0. Null parts hash as any value."""
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def write_sharded(df: DataFrame, path: str, key: str, shards: int = 64) -> None:
    """Parquet files of one shard of ``key`` each, rows in key order within; a lookup by key then reads one folder.

    The spread over tasks is by shard, key and the row's position, so a key with
    a third of all rows fills several files instead of one task.
    """
    placed = df.withColumn("shard", shard(F.col(key), shards=shards))
    placed.repartitionByRange("shard", key, F.monotonically_increasing_id()).sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, key: str, value: str, shards: int = 64, schema: T.StructType | None = None) -> DataFrame:
    """Rows of one key, from its shard's folder alone. Without ``schema``, that of the files, there must be some."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])) if schema else spark.read
    return reader.parquet(path).where((F.col("shard") == shard(F.lit(value), shards=shards)) & (F.col(key) == value)).drop("shard")


# How dumps of joined tables name their columns.
PREFIXED = {"resource_manager_entity": "services.resource_manager_entity", "event_type": "events.type"}


def prefixed(name: str) -> str:
    return PREFIXED.get(name, f"events.{name}")


def read_dump(spark: SparkSession, path: str, kind: str = "json", prefix: bool = False) -> DataFrame:
    """Dump rows from files of JSON lines, Parquet or text YSON, by their fixed schema; absent columns are null.

    With ``prefix`` columns carry the name of the table that they come from, as
    they always do in YSON, where tickets may also be a single text. A line that
    is not whole fails the job: a dump that is cut off must not pass for a whole one.
    """
    use_utc(spark)
    if kind == "yson":
        fields = [T.StructField(prefixed(f.name), T.StringType() if f.name == "tickets" else f.dataType) for f in DUMP]
        rows = read_fragments(spark, path).select(F.from_json("value", T.StructType(fields), {"mode": "FAILFAST"}).alias("r")).select("r.*")
        tickets = F.col(f"`{prefixed('tickets')}`")
        many = F.from_json(tickets, "array<string>")
        rows = rows.withColumn(prefixed("tickets"), F.when(tickets.startswith("["), many).when(tickets.isNotNull(), F.array(tickets)))
        return rows.select(*[F.col(f"`{prefixed(f.name)}`").alias(f.name) for f in DUMP])
    name = prefixed if prefix else str
    schema = T.StructType([T.StructField(name(f.name), f.dataType) for f in DUMP])
    reader = spark.read.schema(schema)
    rows = reader.option("mode", "FAILFAST").json(path) if kind == "json" else reader.parquet(path)
    return rows.select(*[F.col(f"`{name(f.name)}`").alias(f.name) for f in DUMP])


def as_initial_log(rows: DataFrame) -> DataFrame:
    """Stored rows that stand, as live versions of commit 0: what a store without a log starts from."""
    payload = decoded(F.col("event"))
    return rows.where(F.col("removed_at").isNull()).select(
        "id",
        payload["title"].alias("title"),
        F.struct(F.col("resource_type_code").alias("type_code"), F.col("resource_external_id").alias("external_id")).alias("resource"),
        F.timestamp_micros("start_time").cast("timestamp_ntz").alias("start_time"),
        payload["tags"].alias("tags"),
        F.lit(0).cast("bigint").alias("txn_ts"),
        F.lit(False).alias("is_deleted"),
    )
