"""Shifts, counts, pay, leaderboards, teams and live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as vl
from ..session import cut
from .packet_rules import effective_status
from .tables import first_by, latest_by

# Roles hidden from boards, roles that may be unassigned, name-lookup order.
HIDDEN_ROLES = ["boss", "admin"]
FIELD_ROLES = ["petitioner", "worker", "office_worker"]
ROLE_ORDER = {"boss": 0, "admin": 1, "field_manager": 2, "office_worker": 3, "worker": 4}
MANAGER_ROLES = ["field_manager", "boss", "admin"]
MANUAL = "[manual entry]"
HOUR = 3.6e9


def name_key() -> Column:
    return F.lower(F.trim("full_name"))


def by_activity() -> list[Column]:
    return [F.when(F.col("is_active"), 0).otherwise(1), F.col("worker_id")]


def one_per_name(workers: DataFrame, with_role: bool = False) -> DataFrame:
    """One person per name (or name and role): active first, then the lowest id."""
    return first_by(workers, [name_key()] + ([F.col("role")] if with_role else []), by_activity())


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1..n over the whole table, without bringing it into one task.

    The table is range-partitioned and written in order; a part's rows are numbered
    within the part and shifted by the sizes of the parts before it.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_r") + F.col("_skip")).drop(
        "_part", "_r", "_skip")


# ── sheet counts ─────────────────────────────────────────────────────────────

def sheet_summary(signatures: DataFrame) -> DataFrame:
    """Total, the four status counts and the automatic rate of each sheet."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = signatures.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), n("approved").alias("approved"), n("review").alias("review"),
        n("rejected").alias("rejected"), n("duplicate").alias("duplicates"))
    rate = F.col("approved") / F.greatest(F.col("total"), F.lit(1)) * 100
    return out.withColumn("auto_rate_pct", vl.round_py(rate, 1))


def sheet_counts(signatures: DataFrame) -> DataFrame:
    """Total, valid (by effective status) and signed lines of each sheet."""
    valid = effective_status(F.col("staff_override"), F.col("status")) == "approved"
    return signatures.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_sigs"), F.count_if(valid).alias("valid_sigs"),
        F.count_if("signature_present").alias("signed_sigs"))


def worker_header_totals(assignments: DataFrame, headers: DataFrame) -> DataFrame:
    """Totals per worker from header columns; these ignore later overrides."""
    return assignments.join(headers, "project_id").groupBy("worker_id").agg(
        F.sum("total_lines").alias("total_sigs"), F.sum("approved").alias("valid_sigs"))


def worker_line_totals(assignments: DataFrame, signatures: DataFrame) -> DataFrame:
    """Totals per worker from the lines, by effective status."""
    return assignments.join(sheet_counts(signatures), "project_id").groupBy("worker_id").agg(
        F.sum("total_sigs").alias("total_sigs"), F.sum("valid_sigs").alias("valid_sigs"))


def totals_by_cause(sheets: DataFrame, with_rollup: bool = False) -> DataFrame:
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")).alias(c)
    src = sheets.select(known("cause"), known("county"), F.coalesce("total_lines", F.lit(0)).alias("t"),
                        F.coalesce("approved", F.lit(0)).alias("a"))
    grouped = src.rollup("cause", "county") if with_rollup else src.groupBy("cause", "county")
    return grouped.agg(F.count(F.lit(1)).alias("projects"), F.sum("t").alias("total_sigs"), F.sum("a").alias("approved_sigs"))


def total_valid(headers: DataFrame) -> DataFrame:
    return headers.agg(F.coalesce(F.sum("approved"), F.lit(0)).alias("total_valid_sigs"))


def daily_counts(entries: DataFrame, time_from=None, time_to=None) -> DataFrame:
    """Approved signatures per worker and day, hand-count sheets only."""
    src = entries.where(F.col("pdf_path") == MANUAL)
    if time_from is not None:
        src = src.where(F.col("created_at") >= time_from)
    if time_to is not None:
        src = src.where(F.col("created_at") <= time_to)
    return src.groupBy("worker_id", vl.day_key(F.col("created_at")).alias("day")).agg(
        F.sum(F.coalesce("approved", F.lit(0))).alias("day_sigs"))


def fraud_alerts(sheets: DataFrame, assignments: DataFrame, workers: DataFrame, threshold_pct: float = 30.0) -> DataFrame:
    """One row per offending sheet with its worker; the share is of all lines of the sheet."""
    pct = F.col("fraud_flagged_lines") / F.when(F.col("total_lines") > 0, F.col("total_lines")).otherwise(1) * 100
    bad = sheets.where("fraud_flagged_lines is not null").withColumn("pct", pct).where(F.col("pct") >= threshold_pct)
    return (bad.join(assignments.select("project_id", "worker_id"), "project_id")
            .join(workers.select("worker_id", "full_name"), "worker_id")
            .withColumn("flagged_pct", vl.round_py(F.col("pct"), 1)).drop("pct"))


def alerts_per_worker(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("worker_id", "full_name").agg(
        F.count(F.lit(1)).alias("sheets"), F.sum("fraud_flagged_lines").alias("flagged_lines"),
        F.sum("total_lines").alias("total_lines"), F.max("flagged_pct").alias("worst_pct"))


def worker_sheets(assignments: DataFrame, signatures: DataFrame) -> DataFrame:
    """Every assignment with its sheet's line counts (zero without lines) and its place, newest first."""
    w = Window.partitionBy("worker_id").orderBy(F.desc("assigned_at"), "project_id")
    return (assignments.join(sheet_counts(signatures), "project_id", "left").na.fill(0, ["total_sigs", "valid_sigs", "signed_sigs"])
            .withColumn("place", F.row_number().over(w)))


# ── shifts ───────────────────────────────────────────────────────────────────

def worked_micros() -> Column:
    """Microseconds of a closed shift; exact to sum."""
    return F.unix_micros(F.col("clock_out").cast("timestamp")) - F.unix_micros(F.col("clock_in").cast("timestamp"))


def _hours(micros: Column) -> Column:
    return micros / 1e6 / 3600.0


def open_shifts(shifts: DataFrame) -> DataFrame:
    """Latest open shift of each worker."""
    return latest_by(shifts.where("clock_out is null"), ["worker_id"], ["clock_in", "shift_id"])


def shifts_from(shifts: DataFrame, start: Column) -> DataFrame:
    """Shifts since ``start`` with their order within the worker."""
    w = Window.partitionBy("worker_id").orderBy("clock_in", "shift_id")
    return shifts.where(F.col("clock_in") >= start).withColumn("n", F.row_number().over(w))


def named_shifts(shifts: DataFrame, workers: DataFrame) -> DataFrame:
    names = workers.select("worker_id", "full_name")
    return shifts.join(names, "worker_id", "left").withColumns({
        "worker_name": F.coalesce("full_name", F.lit("")),
        "hours": F.when(F.col("clock_out").isNotNull(), vl.round_py(_hours(worked_micros()), 2))}).drop("full_name")


def with_name(df: DataFrame, workers: DataFrame, prefix: str) -> DataFrame:
    """Append worker_name, '<prefix> <id>' for unknown workers."""
    return df.join(workers.select("worker_id", "full_name"), "worker_id", "left").withColumn(
        "worker_name", F.coalesce("full_name", F.concat(F.lit(prefix + " "), F.col("worker_id").cast("string")))).drop("full_name")


def in_periods(shifts: DataFrame, periods: DataFrame) -> DataFrame:
    """Shifts of each pay period, both ends inclusive up to 23:59:59.

    Periods are listed by day, so the range join is an equi-join on the day.
    """
    days = periods.select(
        "pay_period_id", F.to_date("end_date").alias("_end"),
        F.explode(F.sequence(F.to_date("start_date"), F.to_date("end_date"))).alias("_day"))
    return (shifts.withColumn("_day", F.to_date("clock_in")).join(days, "_day")
            .where(F.col("clock_in") <= vl.end_of_day(F.col("_end").cast("timestamp"))).drop("_day", "_end"))


def current_period(periods: DataFrame) -> DataFrame:
    """Newest open period, else the newest."""
    return periods.orderBy((F.col("status") == "open").desc(), F.desc("pay_period_id")).limit(1)


def leaderboard(workers: DataFrame, header_totals: DataFrame, shifts: DataFrame, hidden: list[str] = HIDDEN_ROLES) -> DataFrame:
    """Lifetime board of active field people, ranked by valid signatures.

    People are made one per name before the role filter, as the board always did; ties
    keep the order of ids. The rank is unique.
    """
    people = one_per_name(workers).where(F.col("is_active") & ~F.col("role").isin(hidden))
    worked = shifts.where("clock_out is not null").groupBy("worker_id").agg(F.sum(worked_micros()).alias("micros"))
    busy = shifts.where("clock_out is null").select("worker_id").distinct().withColumn("is_clocked_in", F.lit(True))
    out = (people.join(header_totals, "worker_id", "left").join(worked, "worker_id", "left").join(busy, "worker_id", "left")
           .na.fill(0, ["total_sigs", "valid_sigs", "micros"]).na.fill(False, ["is_clocked_in"]))
    hours, valid = _hours(F.col("micros")), F.col("valid_sigs")
    gross = vl.to_cents(hours * F.col("hourly_wage") * 100)
    out = out.select(
        "worker_id", "full_name", "valid_sigs", "total_sigs",
        vl.round_py(vl.share(valid, F.col("total_sigs"), 100.0), 1).alias("validity_rate"),
        vl.round_py(hours, 2).alias("total_hours"), vl.round_py(vl.share(valid, hours), 2).alias("sigs_per_hour"),
        vl.round_py(vl.share(gross, valid), 2).alias("cost_per_sig_cents"),
        vl.performance_label(valid, hours).alias("tier_label"), "is_clocked_in")
    return global_rank(out, [F.desc("valid_sigs"), F.asc("worker_id")])


def worker_cards(workers: DataFrame, totals: DataFrame, shifts: DataFrame, as_of: Column, without: list[str] = ["boss"]) -> DataFrame:
    """Today's hours up to ``as_of``, estimated pay and validity of every listed worker."""
    people = one_per_name(workers.where(~F.col("role").isin(without)), with_role=True)
    opened = open_shifts(shifts).select("worker_id", F.col("shift_id").alias("_open"), F.col("clock_in").alias("clock_in_time"))
    today = shifts.where(F.col("clock_in") >= vl.day_start(as_of)).join(opened.select("worker_id", "_open"), "worker_id", "left")
    now = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("clock_in").cast("timestamp"))
    spent = F.when(F.col("clock_out").isNotNull(), worked_micros()).when(F.col("shift_id") == F.col("_open"), now).otherwise(0)
    hours = today.groupBy("worker_id").agg(F.sum(spent).alias("micros"))
    out = (people.join(opened, "worker_id", "left").join(hours, "worker_id", "left").join(totals, "worker_id", "left")
           .na.fill(0, ["micros", "total_sigs", "valid_sigs"]))
    return out.select(
        "worker_id", "full_name", "role", F.col("_open").isNotNull().alias("is_clocked_in"), "clock_in_time",
        vl.round_py(_hours(F.col("micros")), 2).alias("today_hours"), "total_sigs", "valid_sigs",
        vl.round_py(vl.share(F.col("valid_sigs"), F.col("total_sigs"), 100.0), 1).alias("validity_rate"),
        vl.to_cents(_hours(F.col("micros")) * F.col("hourly_wage") * 100).alias("estimated_pay_cents"))


# ── pay ──────────────────────────────────────────────────────────────────────

def shift_pay(workers: DataFrame, shifts: DataFrame, line_totals: DataFrame, entries: DataFrame,
              period_id: int, start: str, end: str) -> DataFrame:
    """Pay of every closed shift of active workers in one period.

    A day's hand count sets the wage and the bonus of each shift of that day; a worker
    without any hand count in the period falls back to the period's rate, and the bonus
    credit is then shared by hours. Unapproved shifts are paid too.
    """
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(f"{end} 23:59:59").cast("timestamp_ntz")
    done = shifts.where(F.col("clock_out").isNotNull() & F.col("clock_in").between(lo, hi)).withColumns({
        "day": vl.day_key(F.col("clock_in")), "micros": worked_micros()})
    done = done.join(workers.where("is_active").select("worker_id", "hourly_wage"), "worker_id")
    daily = daily_counts(entries, lo, hi)
    totals = done.groupBy("worker_id").agg(F.sum("micros").alias("total_micros"))
    counted = daily.select("worker_id").distinct().withColumn("has_daily", F.lit(True))
    s = (done.join(totals, "worker_id").join(daily, ["worker_id", "day"], "left").join(counted, "worker_id", "left")
         .join(line_totals.select("worker_id", "valid_sigs"), "worker_id", "left")
         .na.fill(0, ["day_sigs", "valid_sigs"]).na.fill(False, ["has_daily"]))
    hours, total = _hours(F.col("micros")), _hours(F.col("total_micros"))
    rate = vl.share(F.col("valid_sigs"), total)
    full = F.when(F.col("has_daily"), F.col("day_sigs") >= vl.FULL_WAGE_DAY_COUNT).otherwise(rate >= vl.FULL_WAGE_HOURLY)
    credit = F.when(F.col("has_daily"), F.col("day_sigs")).when(
        total > 0, vl.to_cents(F.col("valid_sigs") * hours / total)).otherwise(0)
    s = s.withColumns({"hours": hours, "wage_used": vl.wage_used(F.col("hourly_wage"), full), "credit": credit})
    s = s.withColumn("b", vl.bonus(F.col("credit"), F.col("is_weekend")))
    return s.select(
        F.lit(period_id).cast("bigint").alias("pay_period_id"), "worker_id", "shift_id", "day", "is_weekend", "approved",
        "micros", vl.round_py(F.col("hours"), 2).alias("hours"), "day_sigs", "wage_used",
        vl.to_cents(F.col("hours") * F.col("wage_used") * 100).alias("base_pay_cents"),
        F.col("credit").alias("valid_sigs_attributed"), "b.bonus_cents", "b.earns_lunch")


def pay_run(workers: DataFrame, paid_shifts: DataFrame, line_totals: DataFrame, period_id: int) -> DataFrame:
    """One pay record per active worker of one period, zeros where nothing was worked."""
    per = paid_shifts.groupBy("worker_id").agg(
        F.sum("micros").alias("micros"), F.sum("base_pay_cents").alias("base_pay_cents"),
        F.sum("bonus_cents").alias("bonus_cents"), F.bool_or("earns_lunch").alias("earns_lunch"))
    out = (workers.where("is_active").select("worker_id", "full_name", "hourly_wage")
           .join(per, "worker_id", "left").join(line_totals, "worker_id", "left")
           .na.fill(0, ["micros", "base_pay_cents", "bonus_cents", "total_sigs", "valid_sigs"]).na.fill(False, ["earns_lunch"]))
    hours = _hours(F.col("micros"))
    gross = F.col("base_pay_cents") + F.col("bonus_cents")
    out = out.withColumns({"gross_cents": gross, "tax_cents": vl.tax_cents(gross)})
    return out.select(
        F.lit(period_id).cast("bigint").alias("pay_period_id"), "worker_id", "full_name",
        vl.round_py(hours, 2).alias("total_hours"), F.col("total_sigs").alias("total_signatures"),
        F.col("valid_sigs").alias("valid_signatures"),
        vl.round_py(vl.share(F.col("valid_sigs"), F.col("total_sigs"), 100.0), 1).alias("validity_rate"),
        vl.round_py(vl.share(F.col("valid_sigs"), hours), 2).alias("sigs_per_hour"),
        vl.round_py(F.when(hours > 0, F.col("base_pay_cents") / 100 / hours).otherwise(F.col("hourly_wage")), 2).alias("hourly_wage_used"),
        "base_pay_cents", "bonus_cents", "earns_lunch", "gross_cents", "tax_cents",
        (F.col("gross_cents") - F.col("tax_cents")).alias("net_cents"))


def pay_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("pay_period_id").agg(
        F.count(F.lit(1)).alias("workers_processed"), F.sum("gross_cents").alias("total_gross_cents"),
        F.sum("net_cents").alias("total_net_cents"))


def profit_and_loss(records: DataFrame, revenue_cents: int = 0) -> DataFrame:
    """Cost and margin over all given records; the margin share is null without revenue."""
    out = records.agg(
        F.coalesce(F.sum("gross_cents"), F.lit(0)).alias("total_labor_gross_cents"),
        F.coalesce(F.sum("net_cents"), F.lit(0)).alias("total_labor_net_cents"),
        F.coalesce(F.sum("valid_signatures"), F.lit(0)).alias("total_valid_signatures"),
        F.coalesce(F.sum(F.col("total_hours").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("h"),
        F.countDistinct("worker_id").alias("worker_count"))
    gross, revenue = F.col("total_labor_gross_cents"), F.lit(revenue_cents).cast("bigint")
    return out.select(
        "total_labor_gross_cents", "total_labor_net_cents", "total_valid_signatures",
        vl.round_py(F.col("h"), 2).alias("total_hours"),
        vl.round_py(vl.share(gross, F.col("total_valid_signatures")), 2).alias("cost_per_sig_cents"),
        vl.round_py(vl.share(gross, F.col("h")), 2).alias("cost_per_hour_cents"),
        revenue.alias("revenue_cents"), (revenue - gross).alias("margin_cents"),
        F.when(revenue > 0, vl.round_py((revenue - gross) / revenue * 100, 1)).alias("margin_pct"), "worker_count")


def tier_progress(records: DataFrame, shift_counts: DataFrame) -> DataFrame:
    """Average signatures a shift and the way to the next weekday tier."""
    # Tier floors, labels and next floors.
    tiers = [(80, "$60 bonus + lunch", None), (70, "$40 bonus", 80), (60, "$20 bonus", 70),
             (50, "Free lunch", 60), (40, "Base pay", 50), (0, "Below threshold", 40)]
    out = records.join(shift_counts, "worker_id", "left").na.fill(0, ["shifts"])
    avg = F.when(F.col("shifts") > 0, F.floor(F.col("valid_signatures") / F.col("shifts") + 0.5)).otherwise(0)
    out = out.withColumn("avg_sigs", avg.cast("bigint"))
    tier = None
    for floor, label, nxt in tiers:
        done = F.lit(100.0) if nxt is None else (F.col("avg_sigs") - floor) / float(nxt - floor) * 100
        cell = F.struct(F.lit(label).alias("tier"), F.lit(nxt).cast("int").alias("next_at"),
                        F.least(F.lit(100.0), F.greatest(F.lit(0.0), done)).alias("progress_pct"))
        tier = F.when(F.col("avg_sigs") >= floor, cell) if tier is None else tier.when(F.col("avg_sigs") >= floor, cell)
    return out.withColumn("t", tier).select("worker_id", "avg_sigs", "t.tier", "t.next_at",
                                            F.floor(F.col("t.progress_pct") + 0.5).cast("bigint").alias("progress_pct"))


# ── people, teams, live state ────────────────────────────────────────────────

def find_by_name(workers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Best-placed active worker for each wanted name, without regard to case."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv]), F.col("role")), F.lit(9))
    found = wanted.select(F.lower(F.trim("wanted_name")).alias("_n")).distinct().join(
        workers.where("is_active").withColumn("_n", F.lower("full_name")), "_n")
    return first_by(found.drop("_n"), [F.lower("full_name")], [rank, F.col("worker_id")])


def unassigned(workers: DataFrame) -> DataFrame:
    return workers.where(F.col("team_id").isNull() & F.col("is_active") & F.col("role").isin(FIELD_ROLES))


def latest_counts(events: DataFrame) -> DataFrame:
    """Last submitted count of each worker."""
    return latest_by(events, ["worker_id"], ["ts", "event_id"])


def latest_positions(pins: DataFrame) -> DataFrame:
    """Last position of each worker; a deleted position is null."""
    return latest_by(pins, ["worker_id"], ["ts", "event_id"])


def live_overlay(counts: DataFrame, positions: DataFrame, workers: DataFrame) -> DataFrame:
    """Counts of known workers with positions laid over; others appear while they have a position."""
    named = workers.select("worker_id", "full_name")
    out = (counts.select("worker_id", "sig_count").join(positions.select("worker_id", "lat", "lng"), "worker_id", "full_outer")
           .join(named, "worker_id", "left"))
    counted = F.col("sig_count").isNotNull() & F.col("full_name").isNotNull()
    return out.where(counted | F.col("lat").isNotNull()).select(
        "worker_id", F.coalesce("full_name", F.lit("")).alias("full_name"),
        F.coalesce("sig_count", F.lit(0)).alias("sig_count"), "lat", "lng")


def team_members(teams: DataFrame, workers: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per member with the live count; teams without members give one empty row."""
    m = workers.where("team_id is not null").select("team_id", "worker_id", "full_name", "role").join(
        counts.select("worker_id", "sig_count"), "worker_id", "left")
    return teams.select("team_id", "team_name", "manager_id").join(m, "team_id", "left").withColumn(
        "sig_count", F.coalesce("sig_count", F.lit(0)))


def team_leaderboard(teams: DataFrame, workers: DataFrame, counts: DataFrame) -> DataFrame:
    totals = team_members(teams, workers, counts).groupBy("team_id", "team_name", "manager_id").agg(
        F.count("worker_id").alias("member_count"), F.sum("sig_count").alias("total_sigs"))
    boss = workers.select(F.col("worker_id").alias("manager_id"), F.col("full_name").alias("_boss"))
    return (totals.join(boss, "manager_id", "left").withColumn("manager_name", F.coalesce("_boss", F.lit(""))).drop("_boss")
            .orderBy(F.desc("total_sigs"), "team_id"))


def own_team(workers: DataFrame, teams: DataFrame, managers: list[str] = MANAGER_ROLES) -> DataFrame:
    """Each worker's team: the one they manage for managers (lowest id), else the one they belong to."""
    led = first_by(teams.where("manager_id is not null"), [F.col("manager_id")], [F.col("team_id")]).select(
        F.col("manager_id").alias("worker_id"), F.col("team_id").alias("_led"))
    out = workers.join(led, "worker_id", "left").withColumn(
        "own_team_id", F.when(F.col("role").isin(managers), F.col("_led")).otherwise(F.col("team_id")))
    return out.join(teams.select(F.col("team_id").alias("own_team_id"), "team_name"), "own_team_id").select(
        "worker_id", "role", "own_team_id", "team_name")


def active_people(workers: DataFrame, hidden: list[str] = [*HIDDEN_ROLES, "field_manager"]) -> DataFrame:
    """Names offered for selection, one per name, with the label of their role."""
    from ..functions.text import role_label
    shown = workers.where(F.col("is_active") & ~F.col("role").isin(hidden))
    return first_by(shown, [name_key()], by_activity()).select("worker_id", "full_name", role_label(F.col("role")).alias("role_label"))
