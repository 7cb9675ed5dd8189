"""Schemas of events, their versions, and dump rows."""

from __future__ import annotations

from pyspark.sql import types as T

RESOURCE = T.StructType([T.StructField("type_code", T.StringType()), T.StructField("external_id", T.StringType())])

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("resource", RESOURCE),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
        # kept as they are given; nothing here reads or sets them
        T.StructField("created_by", T.StringType()),
        T.StructField("updated_by", T.StringType()),
        T.StructField("create_time", T.TimestampNTZType()),
        T.StructField("update_time", T.TimestampNTZType()),
        T.StructField("delete_time", T.TimestampNTZType()),
    ]
)

#: What an update may change; anything else in a mask is ignored.
MUTABLE = ("title", "description", "start_time", "end_time", "tags", "annotations")

VERSION = T.StructType([*EVENT.fields, T.StructField("txn_ts", T.LongType()), T.StructField("is_deleted", T.BooleanType())])

_TEXTS, _INT, _LONG, _TEXT = T.ArrayType(T.StringType()), T.IntegerType(), T.LongType(), T.StringType()
DUMP = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("attendees", _TEXTS), ("calendar_event_id", _INT), ("components", _TEXTS), ("created_at", _LONG),
            ("created_by", _TEXT), ("dcs", _TEXTS), ("description", _TEXT), ("environment_id", _INT), ("finish_time", _INT),
            ("id", _INT), ("is_deleted", T.BooleanType()), ("meta", _TEXT), ("service_id", _INT), ("severity", _TEXT),
            ("start_time", _INT), ("tickets", _TEXTS), ("title", _TEXT), ("event_type", _TEXT), ("updated_at", _LONG),
            ("updated_by", _TEXT),
            ("resource_manager_entity", T.StructType([T.StructField("type", _TEXT), T.StructField("slug", _TEXT)])),
        )
    ]
)
