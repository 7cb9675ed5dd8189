"""Command line: load dump files into a store, list a page, show statistics, compact.

    python -m tidemark load --store DIR --input FILE [--kind json|parquet|yson] [--batches N]
    python -m tidemark list --store DIR --request REQUEST.json
    python -m tidemark stats --store DIR
    python -m tidemark compact --store DIR [--forget-before SNAPSHOT]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions import dump
from tidemark.operators.measures import load_statistics
from tidemark.plans.listing import request_fields
from tidemark.session import build_session, scratch_path
from tidemark.sources.rows import read_dump
from tidemark.store import EventStore


def load(spark: SparkSession, store: EventStore, path: str, kind: str, batches: int, name: str) -> dict:
    """Map dump rows and append them, split by a hash of their id into so many commits.

    Of rows with one id and a service the first by creation, then update, is taken. Batches
    are tagged by ``name``, so a load that failed half-way can be run again. Mapping happens
    once, into a table by batch. Latencies of the commits are summarised.
    """
    rows = read_dump(spark, path, kind).withColumn("__order", F.struct("created_at", "updated_at", F.monotonically_increasing_id()))
    # the mapped event has no place for the dump's own columns, so they go before
    events = dump.mapped(dump.first_seen(dump.with_service(rows), "id", "__order").drop("__order"))
    path = scratch_path(spark, "load")
    events.withColumn("__batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("__batch").parquet(path)
    mapped = spark.read.schema(StructType([*events.schema.fields, StructField("__batch", IntegerType())])).parquet(path)
    took = []
    for n in range(batches):
        begun = time.perf_counter()
        store.create(mapped.where(F.col("__batch") == n).drop("__batch"), tag=f"{name}/{n}")
        took.append((time.perf_counter() - begun,))
    seconds, total = sum(t for t, in took), mapped.count()
    latencies = load_statistics(spark.createDataFrame(took, "seconds double"), "seconds").first().asDict()
    return {"events": total, "seconds": seconds, "per_second": total / seconds, "commit_seconds": latencies}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("load", "list", "stats", "compact"))
    parser.add_argument("--store", required=True)
    parser.add_argument("--input")
    parser.add_argument("--kind", choices=("json", "parquet", "yson"), default="json")
    parser.add_argument("--batches", type=int, default=1)
    parser.add_argument("--name", default="load")
    parser.add_argument("--request")
    parser.add_argument("--forget-before", type=int)
    asked = parser.parse_args(argv)
    store = EventStore(spark or build_session(), asked.store)
    if asked.command == "load":
        if not asked.input:
            parser.error("load needs --input")
        shown = load(store.spark, store, asked.input, asked.kind, asked.batches, asked.name)
    elif asked.command == "list":
        if not asked.request:
            parser.error("list needs --request")
        with open(asked.request) as file:
            page = store.list(**request_fields(json.load(file)))
        shown = {"events": [r.asDict(recursive=True) for r in page.rows], "next_page_token": page.next_page_token, "stats": store.statistics()}
    else:
        if asked.command == "compact":
            store.compact(asked.forget_before)
        shown = store.statistics()
    json.dump(shown, sys.stdout, default=str, indent=1)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
