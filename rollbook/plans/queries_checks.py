"""Sources and sinks, visibility, and checks on submitted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import layout, packet_rules, quality, tables
from ..session import cut, work_folder
from ..sources import buckets, files, roll
from .oracle_views import expanded, sequence_ctes, with_ctes
from .registry import query

REVIEWERS = ["field_manager", "boss"]


def written(v, name: str) -> str:
    """A folder of this application for a query that writes and reads again."""
    import uuid
    return f"{work_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


# ── sources and sinks ────────────────────────────────────────────────────────

@query("s1_read_roll", with_ctes("""
select voter_id, last_name, first_name, street_address, case when roll_pos%10=0 then '' else city end city, zip_code,
  row_number() over (order by roll_pos) roll_pos from roll""", "roll"))
def _(v):
    """The registry as several CSV files with untidy headers and missing cells, read back in file order."""
    path = written(v, "roll")
    told = v.roll.withColumn("city", F.when(F.col("roll_pos") % 20 == 0, "N/A").when(F.col("roll_pos") % 10 == 0, "").otherwise(F.col("city")))
    ordered = told.orderBy("roll_pos").select("voter_id", "last_name", "first_name", "street_address", "city", "zip_code")
    files.write_csv(ordered.toDF(" Voter_ID", "LAST_NAME ", "First_Name", "street_address", "City", "zip_code"), path)
    return roll.read_roll(v.spark, path)


@query("s4_read_table", "select n_nationkey, n_name, n_regionkey from nation")
def _(v):
    return files.read_table(v.spark, v.dir, "nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("s9_json_round_trip", with_ctes("select project_id, line_number, raw_name, signature_present from lines", "lines"))
def _(v):
    path = written(v, "json")
    rows = v.lines.select("project_id", "line_number", "raw_name", "signature_present")
    files.write_json(rows, path)
    return v.spark.read.schema(rows.schema).json(path)


@query("s10_saved_sheets", with_ctes("""
select project_id, line_number, case when project_id%3=0 then upper(raw_name) else raw_name end raw_name from lines where project_id%3<>0 or line_number<=4""", "lines"))
def _(v):
    """All sheets are stored, then every third again with fewer lines."""
    path = written(v, "sheets")
    rows = cut(v.lines.select("project_id", "line_number", "raw_name"))
    files.save_sheets(rows, path)
    files.save_sheets(rows.where("project_id % 3 = 0 and line_number <= 4").withColumn("raw_name", F.upper("raw_name")), path)
    return buckets.read_buckets(v.spark, path).select("project_id", "line_number", "raw_name")


@query("t3_first_rows", with_ctes("select project_id, line_number, raw_name from lines where line_number<=5", "lines"))
def _(v):
    return layout.first_rows(v.lines, 5).select("project_id", "line_number", "raw_name")


@query("x3_sequence_ratio_in_sql", with_ctes("""
select project_id, line_number, ratio from said join sr on sr.a=said.a and sr.b=said.b""", "lines", "roll", extra={
    "said": f"""select project_id, line_number, {expanded('first_name')} a, {expanded('raw_name')} b
        from lines join roll on voter_id=true_voter_id""", **sequence_ctes("sr", "said")}))
def _(v):
    sim.register(v.spark)
    pairs = v.lines.join(v.roll.select(F.col("voter_id").alias("true_voter_id"), "first_name"), "true_voter_id")
    pairs = pairs.select("project_id", "line_number", tx.expand_streets(F.col("first_name")).alias("a"), tx.expand_streets(F.col("raw_name")).alias("b"))
    return v.spark.sql("select project_id, line_number, sequence_ratio(a, b) as ratio from {pairs}", pairs=pairs)


# ── who sees what ────────────────────────────────────────────────────────────

@query("p5_visible_counts", with_ctes("""
select worker_id viewer_id, case when role in ('field_manager','boss') then (select count(*) from assignments) else coalesce(n,0) end n_rows
from workers left join (select worker_id, count(*) n from assignments group by 1) a using (worker_id)""", "workers", "assignments"))
def _(v):
    viewers = v.workers.select(F.col("worker_id").alias("viewer_id"), F.col("role").isin(REVIEWERS).alias("is_reviewer"))
    return tables.visible_counts(v.assignments, viewers)


@query("p5_reviewer_rows", with_ctes("select project_id, worker_id from assignments", "assignments"))
def _(v):
    return tables.visible(v.assignments, None, True).select("project_id", "worker_id")


# ── checks on submitted rows ─────────────────────────────────────────────────

@query("p10_d2_shift_checks", with_ctes("""
select shift_id, case when shift_id%7=0 then 'bad_clock_in' when shift_id%11=0 then 'bad_clock_out'
  when clock_out is not null and shift_id%5=0 then 'out_not_after_in' end reason from shifts""", "shifts"))
def _(v):
    """Submitted texts: times that are none, days that do not exist, outs at the time of the in."""
    n, iso = F.col("shift_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    told = v.shifts.select(
        "shift_id", F.when(n % 14 == 0, "soon").when(n % 7 == 0, "2024-02-31T10:00:00").otherwise(iso("clock_in")).alias("clock_in"),
        F.when(n % 11 == 0, "25:00").when(F.col("clock_out").isNull(), F.when(n % 2 == 0, "")).when(n % 5 == 0, iso("clock_in"))
        .otherwise(iso("clock_out")).alias("clock_out"))
    return told.select("shift_id", quality.validity_errors(quality.shift_checks()).alias("reason"))


@query("p10_count_hours_wage_checks", with_ctes("""
select event_id, case when sig_count%10=3 then 'negative_count' when sig_count%10=4 then 'no_hours' when sig_count%10=5 then 'bad_wage' end reason
from live_events""", "live_events"))
def _(v):
    """Counts below zero, reports without hours, wages of nothing; a missing number fails its check as well."""
    k = F.col("sig_count") % 10
    told = v.live_events.select(
        "event_id", F.when(k == 3, -1).otherwise(F.col("sig_count")).alias("sig_count"), F.when(k == 3, None).otherwise(F.col("sig_count")).alias("sigs_reported"),
        F.when(k == 4, 0.0).otherwise(8.0).alias("hours_worked"), F.when(k != 5, 18.5).alias("hourly_wage"))
    checks = {**quality.count_checks(), **quality.reflection_checks(), **quality.wage_checks()}
    return told.select("event_id", quality.validity_errors(checks).alias("reason"))


@query("p12_accepted_decisions", with_ctes("""
select packet_id, line_no, case when line_no%6=1 then 'bad_action' when line_no%6=2 then 'bad_decision' end reason from packet_review""", "packet_review"))
def _(v):
    n = F.col("line_no")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), n % len(words) + 1)
    told = v.packet_review.select("packet_id", "line_no", F.when(n % 6 == 1, "Approved").otherwise(pick(packet_rules.ACTIONS)).alias("action"),
                                  F.when(n % 6 == 2, None).otherwise(pick(packet_rules.DECISIONS)).alias("review_decision"))
    checks = quality.domain_check("action", packet_rules.ACTIONS, "bad_action") | quality.domain_check("review_decision", packet_rules.DECISIONS, "bad_decision")
    return told.select("packet_id", "line_no", quality.validity_errors(checks).alias("reason"))
