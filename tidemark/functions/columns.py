"""Scalar expressions that several operators share; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
URN_PREFIX = "urn:uuid:"
OPEN_END = "2105-12-31 23:59:59"
MICROS_PER_DAY = 86_400_000_000


def canonical_id(raw: Column) -> Column:
    """An id in one spelling.

    Blanks around it are trimmed and it is lower-cased; a leading ``urn:uuid:``,
    braces and hyphens are dropped, and if 32 hex digits remain these are
    written 8-4-4-4-12. Anything else stays as trimmed, lower-cased text. Null
    stays null, the empty text empty.
    """
    text = F.lower(F.trim(raw))
    bare = F.regexp_replace(F.regexp_replace(text, rf"\A{URN_PREFIX}", ""), "[{}-]", "")
    parts = r"([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})"
    # nearly all ids are in this form already and skip the rest
    done = text.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
    dashed = F.regexp_replace(bare, rf"\A{parts}\z", "$1-$2-$3-$4-$5")
    return F.when(done, text).when(bare.rlike(r"\A[0-9a-f]{32}\z"), dashed).otherwise(text)


def item_text(raw: Column) -> Column:
    """Trimmed of blanks and lower-cased; null if nothing remains."""
    text = F.lower(F.trim(raw))
    return F.when(text != "", text)


def micros(stamp: Column) -> Column:
    """Microseconds since the epoch; zone-less stamps mean UTC (the session is in UTC)."""
    return F.unix_micros(stamp.cast("timestamp"))


def month_of_micros(us: Column) -> Column:
    """``yyyy-MM`` of microseconds since the epoch, null for null."""
    days = ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("int")  # whole, so exact as a double
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM")
