"""The listing query: one page of the newest events that match, or all pages at once."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.filterlang import Mode, compile_filter
from tidemark.functions.columns import micros
from tidemark.operators import versions as v
from tidemark.plans.cursor import PageToken, decode, encode
from tidemark.session import cut_lineage, width_for

EPOCH = datetime.datetime(1970, 1, 1)
#: A page is collected, so its size is bounded; longer results are what ``listed`` is for.
MAX_PAGE_SIZE = 10_000


@dataclass(frozen=True)
class Request:
    """What to list. A page token brings its snapshot along, and ``as_of`` None means the newest."""

    filter: str = ""
    start: datetime.datetime | None = None
    end: datetime.datetime | None = None
    as_of: int | None = None
    page_size: int | None = None
    page_token: str = ""
    mode: Mode = Mode()


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_page_token: str


def request_fields(message: Mapping[str, Any]) -> dict[str, Any]:
    """Fields of a :class:`Request` from a JSON message with page_size, page_token, start_time, end_time and filter.

    Times are ISO 8601 and mean UTC without a zone; absent ones are unbounded.
    """

    def moment(text: str | None) -> datetime.datetime | None:
        if not text:
            return None
        at = datetime.datetime.fromisoformat(text)
        return at.astimezone(datetime.UTC).replace(tzinfo=None) if at.tzinfo else at

    return {
        "page_size": message.get("page_size"),
        "page_token": message.get("page_token") or "",
        "start": moment(message.get("start_time")),
        "end": moment(message.get("end_time")),
        "filter": message.get("filter") or "",
    }


def matching(log: DataFrame | v.Snapshots, request: Request) -> DataFrame:
    """All matching events of the snapshot, unordered.

    The filter applies to the newest visible version of an event, never to one
    that it superseded. Pages after the first start at their token's key.
    """
    token = decode(request.page_token) if request.page_token else None
    as_of = token.as_of if token and token.as_of is not None else request.as_of
    found = v.state_of(log, as_of).where(v.overlaps(request.start, request.end)).where(compile_filter(request.filter, mode=request.mode))
    if token:
        found = found.where(v.at_or_after(EPOCH + datetime.timedelta(microseconds=token.start_us), token.id))
    return found


def listed(log: DataFrame | v.Snapshots, request: Request) -> DataFrame:
    """Matching events, newest first; with a page size at most that many."""
    found = v.newest_first(matching(log, request))
    if request.page_size is None:
        return found
    if request.page_size < 1:
        raise ValueError("page_size must be at least 1")
    return found.limit(request.page_size)


def _pinned(log: DataFrame | v.Snapshots, request: Request) -> Request:
    """The request with its page size checked, of the newest snapshot if neither it nor a token names one."""
    if request.page_size is None:
        raise ValueError("a page needs a page_size")
    if not 1 <= request.page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page has 1 to {MAX_PAGE_SIZE} events")
    if request.as_of is None and not request.page_token:
        newest = (log.log if isinstance(log, v.Snapshots) else log).agg(F.max("txn_ts")).first()[0]
        request = replace(request, as_of=newest if newest is not None else 0)
    return request


def page(log: DataFrame | v.Snapshots, request: Request, payload: tuple[str, ...] | None = None) -> Page:
    """One page and the token of the next, empty after the last.

    The page is cut on keys alone. Its payload is fetched for these ids, a
    condition that goes below the resolution, to the scan.
    """
    request = _pinned(log, request)
    keys = listed(log, replace(request, page_size=request.page_size + 1)).select("id", "start_time", "txn_ts", "resource").collect()
    token = ""
    if len(keys) > request.page_size:
        key = keys.pop()
        us = (key.start_time - EPOCH) // datetime.timedelta(microseconds=1)
        as_of = request.as_of if not request.page_token else decode(request.page_token).as_of
        owner = key.resource
        token = encode(PageToken((owner and owner.type_code) or "", (owner and owner.external_id) or "", us, key.id, as_of))
    if not keys:
        return Page([], token)
    as_of = decode(request.page_token).as_of if request.page_token else request.as_of
    rows = v.state_of(log, as_of if as_of is not None else request.as_of).where(F.col("id").isin([k.id for k in keys]))
    by_id = {r.id: r for r in (rows.select(*dict.fromkeys((*payload, "id"))) if payload else rows).collect()}
    return Page([by_id[k.id] for k in keys if k.id in by_id], token)


#: Bits of the number of a row within its partition, in what monotonically_increasing_id gives.
ROW_BITS = 33
_TOKENS = "page bigint, page_token string, from_us bigint, from_id string"


def _tokens(as_of: int | None):
    """First keys of pages to their tokens, and to the keys that are read back from these."""

    def of(batches):
        for batch in batches:
            out = []
            for key in batch.to_pylist():
                token = encode(PageToken(key["type_code"] or "", key["external_id"] or "", key["us"], key["id"], as_of))
                read = decode(token)
                out.append((key["page"], token, read.start_us, read.id))
            columns = zip(*out) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page", "page_token", "from_us", "from_id"])

    return of


def all_pages(log: DataFrame | v.Snapshots, request: Request) -> DataFrame:
    """The events of all pages from the request on, with ``page``, from 0, and ``page_token``, which asks :func:`page` for that page.

    The matching events are sorted once, by range, and numbered in that order.
    Every page_size-th is the first key of a page and becomes its token. A page
    holds the events from the key that its token says up to that of the next,
    so together they are whole only if the tokens are. Work and shuffle grow
    with the events, not with their pages, and no event comes to the driver.
    Events without a start, which no token can name, are left out.
    """
    request = _pinned(log, request)
    as_of = decode(request.page_token).as_of if request.page_token else request.as_of
    found = matching(log, request).where(F.col("start_time").isNotNull())
    spark, order = found.sparkSession, [F.col(c).desc() for c in v.NEWEST_FIRST]
    placed = found.repartitionByRange(width_for(found), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "listing").withColumn("__part", F.shiftright("__at", ROW_BITS))
    before, n = [], 0
    for part, rows in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        before.append((part, n))
        n += rows
    offsets = F.broadcast(spark.createDataFrame(before, "__part bigint, __before bigint"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = placed.join(offsets, "__part").withColumn("__number", number).withColumn("page", F.expr(f"__number div {request.page_size}"))
    first = numbered.where((F.col("__number") % request.page_size == 0) & (F.col("page") > 0))
    keys = first.select("page", "resource.type_code", "resource.external_id", micros(F.col("start_time")).alias("us"), "id")
    tokens = cut_lineage(keys.mapInArrow(_tokens(as_of), _TOKENS), "tokens")
    begin = F.col("from_us"), F.col("from_id")
    opens = tokens.select("page", "page_token", F.struct(*begin).alias("__from"))
    ends = tokens.select((F.col("page") - 1).alias("page"), F.struct(*begin).alias("__to"))
    key = F.struct(micros(F.col("start_time")).alias("from_us"), F.col("id").alias("from_id"))
    cut = numbered.join(opens, "page", "left").join(ends, "page", "left").where(
        (F.col("__from").isNull() | (key <= F.col("__from"))) & (F.col("__to").isNull() | (key > F.col("__to")))
    )
    return cut.select(*found.columns, "page", F.coalesce("page_token", F.lit(request.page_token)).alias("page_token"))
