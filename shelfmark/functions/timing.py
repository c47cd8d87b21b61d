"""Dates, expiry and freshness. "Now" is always the ``as_of`` argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000
EXPIRING_SOON_DAYS = 7
FRESH_MINUTES = 30
DELAYED_MINUTES = 120
FRESHNESS_RANKS = ("fresh", "delayed", "stale")


def instant(as_of: dt.datetime | dt.date | str | Column) -> Column:
    """The reference time as a literal, read as UTC when it has no zone."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(round(as_of.timestamp() * 1_000_000)))


def day_of(as_of) -> Column:
    return F.to_date(instant(as_of))


def days_before(as_of, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(days=F.lit(days))


def days_after(as_of, days: int) -> Column:
    return instant(as_of) + F.make_dt_interval(days=F.lit(days))


def in_utc_day(stamp: Column, as_of) -> Column:
    """[start of day, start of next day), as a range on the raw column so that it is pushed down."""
    start = day_of(as_of).cast("timestamp")
    return (stamp >= start) & (stamp < F.date_add(day_of(as_of), 1).cast("timestamp"))


def expiry_status(expiry: Column, as_of) -> Column:
    """Compares instants: past is EXPIRED, within seven days is EXPIRING_SOON, none is OK."""
    return (
        F.when(expiry.isNull(), F.lit("OK"))
        .when(expiry < instant(as_of), F.lit("EXPIRED"))
        .when(expiry <= days_after(as_of, EXPIRING_SOON_DAYS), F.lit("EXPIRING_SOON"))
        .otherwise(F.lit("OK"))
    )


def calendar_days_to(expiry: Column, as_of) -> Column:
    """Compares dates, as the inventory mart does."""
    return F.date_diff(F.to_date(expiry), day_of(as_of))


def whole_days_to(expiry: Column, as_of) -> Column:
    """Whole 24-hour days rounded down, as the expiry rule does: one hour ago is -1."""
    return F.floor((F.unix_micros(expiry) - F.unix_micros(instant(as_of))) / F.lit(DAY_MICROS)).cast("bigint")


def freshness_by_age(updated_at: Column, as_of) -> Column:
    age = F.unix_micros(instant(as_of)) - F.unix_micros(updated_at)
    return (
        F.when(updated_at.isNull(), F.lit("stale"))
        .when(age <= FRESH_MINUTES * 60_000_000, F.lit("fresh"))
        .when(age <= DELAYED_MINUTES * 60_000_000, F.lit("delayed"))
        .otherwise(F.lit("stale"))
    )


def stricter_freshness(computed: Column, stored: Column) -> Column:
    """A stored status can only make the computed one stricter; an unknown one is ignored."""
    ranks = F.array(*[F.lit(name) for name in FRESHNESS_RANKS])
    rank = lambda c: F.array_position(ranks, F.coalesce(F.lower(F.trim(c)), F.lit("")))
    return F.element_at(ranks, F.greatest(rank(computed), rank(stored)).cast("int"))


def whole_days_since(stamp: Column, as_of) -> Column:
    return F.floor((F.unix_micros(instant(as_of)) - F.unix_micros(stamp)) / F.lit(DAY_MICROS)).cast("bigint")


def product_age_text(created_at: Column, as_of) -> Column:
    days = F.greatest(whole_days_since(created_at, as_of), F.lit(0))
    return (
        F.when(created_at.isNull(), F.lit("added recently"))
        .when(days == 0, F.lit("added today"))
        .when(days == 1, F.lit("added 1 day ago"))
        .when(days < 7, F.format_string("added %d days ago", days))
        .otherwise(F.concat(F.lit("added on "), F.date_format(created_at, "MMM dd")))
    )


def minute_text(stamp: Column) -> Column:
    return F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
