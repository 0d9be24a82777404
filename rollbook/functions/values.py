"""Rounding, ratios, pay arithmetic, dates and JSON edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bonus tiers as (valid signatures at least, bonus cents, lunch).
WEEKDAY_TIERS = [(80, 6000, True), (70, 4000, False), (60, 2000, False), (50, 0, True), (40, 0, False), (0, 0, False)]
WEEKEND_TIERS = [(160, 12000, True), (140, 8000, False), (120, 4000, False), (100, 0, True), (80, 0, False), (0, 0, False)]
# Withheld share, capped wage, counts needed for the full wage.
TAX_RATE = 0.313
WAGE_CAP = 20.0
FULL_WAGE_DAY_COUNT = 10
FULL_WAGE_HOURLY = 10.0


def round_py(x: Column, digits: int = 0) -> Column:
    """Round half to even on the exact binary value.

    The product with 10^digits is split into high and low parts, so the rounding
    error of that product is known exactly and only true ties go to the even side.
    """
    x = x.cast("double")
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    p = x * scale
    big = x * 134217729.0
    hi = big - (big - x)
    err = (hi * scale - p) + (x - hi) * scale
    tie = (p - F.floor(p).cast("double")) == 0.5
    near = (F.when(tie & (err > 0), F.ceil(p).cast("double"))
            .when(tie & (err < 0), F.floor(p).cast("double"))
            .otherwise(F.rint(p)))
    return near / scale


def share(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale, 0 when there is nothing to divide by."""
    out = num / den
    return F.when(den > 0, out * scale if scale != 1.0 else out).otherwise(F.lit(0.0))


def truncated_percent(score: Column) -> Column:
    return (score * 100).cast("int")


# ── shifts and pay ───────────────────────────────────────────────────────────

def hours_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1e6 / 3600.0


def shift_hours(clock_in: Column, clock_out: Column) -> Column:
    return F.coalesce(hours_between(clock_in, clock_out), F.lit(0.0))


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def bonus(valid: Column, weekend: Column) -> Column:
    """struct(bonus_cents, earns_lunch) for the signatures of one shift."""
    def tier(table):
        out = None
        for floor, cents, lunch in table:
            cell = F.struct(F.lit(cents).cast("bigint").alias("bonus_cents"), F.lit(lunch).alias("earns_lunch"))
            out = F.when(valid >= floor, cell) if out is None else out.when(valid >= floor, cell)
        return out.otherwise(F.struct(F.lit(0).cast("bigint").alias("bonus_cents"), F.lit(False).alias("earns_lunch")))

    return F.when(weekend, tier(WEEKEND_TIERS)).otherwise(tier(WEEKDAY_TIERS))


def wage_used(own: Column, full: Column) -> Column:
    return F.when(full, own).otherwise(F.least(own, F.lit(WAGE_CAP)))


def to_cents(amount: Column) -> Column:
    return F.rint(amount).cast("bigint")


def tax_cents(gross: Column) -> Column:
    return to_cents(gross.cast("double") * TAX_RATE)


def performance_label(valid: Column, hours: Column) -> Column:
    # Signatures per hour -> label.
    rate = valid / hours
    return (F.when(hours <= 0, "No shifts").when(rate >= 20, "Top Performer").when(rate >= 15, "Gold")
            .when(rate >= 10, "Silver").when(rate >= 5, "Bronze").otherwise("Starting"))


# ── dates ────────────────────────────────────────────────────────────────────

def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def end_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("interval '23:59:59' hour to second")


def week_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def parse_iso(text: Column) -> Column:
    """Timestamp of ISO 8601 text, null when it cannot be read."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(ok, F.try_to_timestamp(text))


# ── JSON ─────────────────────────────────────────────────────────────────────

def json_list(text: Column) -> Column:
    """array<string> of a JSON list; blank gives an empty list, bad text gives null."""
    empty = F.expr("array()").cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(
        F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")))


def json_list_or_empty(text: Column) -> Column:
    return F.coalesce(json_list(text), F.expr("array()").cast("array<string>"))


def append_new(flags: Column, more: Column) -> Column:
    return F.concat(flags, F.filter(F.array_distinct(more), lambda f: ~F.array_contains(flags, f)))
