"""Mapping dump rows to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import OPEN_END

# Fixed values.
RESOURCE_TYPES = {"application": "abc_application", "product": "idp_product", "team": "team"}
NULL_TEXT = "<nil>"


def null_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_TEXT))


def resource_type(kind: Column, strict: bool = True) -> Column:
    """The stored type code; an unknown one fails the job, or is null if not ``strict``."""
    known = F.coalesce(*[F.when(kind == name, F.lit(code)) for name, code in RESOURCE_TYPES.items()])
    if not strict:
        return known
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown resource type: "), null_text(kind))).cast("string"))


def open_end() -> Column:
    return F.to_timestamp_ntz(F.lit(OPEN_END))


def seconds_time(seconds: Column) -> Column:
    """Epoch seconds as a zone-less time; null stays null."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def micros_time(us: Column) -> Column:
    """Epoch microseconds as a zone-less time; null and 0 are the open end."""
    return F.when(us.isNull() | (us == 0), open_end()).otherwise(F.timestamp_micros(us).cast("timestamp_ntz"))


def joined_tags(components: Column, centres: Column) -> Column:
    """Components, then data centres marked ``dc:``; null arrays are empty, null elements are kept as none."""
    none = F.array().cast("array<string>")
    marked = F.transform(F.coalesce(centres, none), lambda c: F.concat(F.lit("dc:"), c))
    return F.filter(F.concat(F.coalesce(components, none), marked), lambda t: t.isNotNull())


def as_json(values: Column) -> Column:
    return F.to_json(values)


def with_service(dump: DataFrame) -> DataFrame:
    """Rows with a service. To be applied before ``first_seen``, or a first copy without one would take its id along."""
    return dump.where(F.col("service_id").isNotNull())


def mapped(dump: DataFrame, strict: bool = True) -> DataFrame:
    """Events of dump rows; rows without a service are dropped, a null finish is open-ended.

    Null title and description become the text ``<nil>``. Rows are not
    de-duplicated here.
    """
    code = resource_type(F.col("resource_manager_entity.type"), strict)
    slug = F.col("resource_manager_entity.slug")
    return with_service(dump).select(
        null_text(F.col("id")).alias("id"),
        null_text(F.col("title")).alias("title"),
        null_text(F.col("description")).alias("description"),
        F.struct(code.alias("type_code"), slug.alias("external_id")).alias("resource"),
        seconds_time(F.col("start_time")).alias("start_time"),
        F.coalesce(seconds_time(F.col("finish_time")), open_end()).alias("end_time"),
        joined_tags(F.col("components"), F.col("dcs")).alias("tags"),
        F.create_map(
            F.lit("resource_type_code"), code,
            F.lit("resource_external_id"), slug,
            F.lit("service_id"), null_text(F.col("service_id")),
            F.lit("created_at"), F.concat(micros_time(F.col("created_at")).cast("string"), F.lit(" +0000 UTC")),
        ).alias("annotations"),
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key are left out.

    Ranked with a limit of one, so each task sends one row a key.
    """
    ranked = df.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")
