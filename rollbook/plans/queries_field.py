"""Shifts, counts, pay, boards, teams and live state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..operators import clock, tables, workforce
from ..streaming import live
from .oracle_views import HOURS, round_py, with_ctes
from .registry import query
from .views import Views

PERIOD = (14, "2024-01-08", "2024-01-14")
AS_OF = "2024-01-20 18:00:00"
H = f"({HOURS}/1e6/3600.0)"


@query("m1_m4_m5_shift_values", with_ctes(f"""
select shift_id, coalesce({H},0.0) as hours, v, case when is_weekend then case when v>=160 then 12000 when v>=140 then 8000 when v>=120 then 4000 else 0 end
  else case when v>=80 then 6000 when v>=70 then 4000 when v>=60 then 2000 else 0 end end bonus_cents,
  case when is_weekend then v>=160 or v between 100 and 119 else v>=80 or v between 50 and 59 end earns_lunch,
  case when coalesce({H},0.0)>0 then v/coalesce({H},0.0) else 0.0 end rate
from (select *, shift_id%180 v from shifts) s""", "shifts"))
def _(v):
    n = F.col("shift_id") % 180
    h = vl.shift_hours(F.col("clock_in"), F.col("clock_out"))
    b = vl.bonus(n, F.col("is_weekend"))
    return v.shifts.select("shift_id", h.alias("hours"), n.alias("v"), b["bonus_cents"].alias("bonus_cents"),
                           b["earns_lunch"].alias("earns_lunch"), vl.share(n, h).alias("rate"))


@query("f20_labels", with_ctes("""
select worker_id, '$'||printf('%.2f', worker_id*137/100.0) money, case when worker_id%8=0 then 'No shifts' when rate>=20 then 'Top Performer' when rate>=15 then 'Gold'
  when rate>=10 then 'Silver' when rate>=5 then 'Bronze' else 'Starting' end tier,
  case role when 'field_manager' then 'Field Manager' when 'worker' then 'Worker' when 'petitioner' then 'Petitioner' when 'office_worker' then 'Staff' else 'Boss' end label
from (select *, worker_id/nullif(cast(worker_id%8 as double),0) rate from workers) w""", "workers"))
def _(v):
    w = F.col("worker_id")
    return v.workers.select("worker_id", tx.money(w * 137).alias("money"),
                            F.when(w % 8 == 0, "No shifts").otherwise(vl.performance_label(w, F.nullif(w % 8, F.lit(0)).cast("double"))).alias("tier"),
                            tx.role_label(F.col("role")).alias("label"))


@query("d1_d3_dates", """
select event_id, isodow(ts)>=6 weekend, strftime(ts,'%Y-%m-%d') as day, date_trunc('day',ts)::timestamp day_start,
  date_trunc('day',ts)::timestamp+interval '86399 seconds' day_end, cast(date_trunc('week',ts) as date) monday from events""")
def _(v):
    t = F.col("ts")
    return v.table("events").select("event_id", vl.is_weekend(t).alias("weekend"), vl.day_key(t).alias("day"),
                                    vl.day_start(t).alias("day_start"), vl.end_of_day(t).alias("day_end"), vl.week_monday(t).alias("monday"))


@query("a2_totals_by_cause", with_ctes("""
select coalesce(nullif(cause,''),'Unknown') cause, coalesce(nullif(county,''),'Unknown') county, count(*) projects,
  sum(total_lines) total_sigs, sum(approved) approved_sigs from sheets group by 1,2""", "sheets"))
def _(v):
    return workforce.totals_by_cause(v.sheets)


@query("a2_totals_by_cause_rollup", with_ctes("""
select cause, county, count(*) projects, sum(total_lines) total_sigs, sum(approved) approved_sigs from (
  select coalesce(nullif(cause,''),'Unknown') cause, coalesce(nullif(county,''),'Unknown') county, total_lines, approved from sheets) s
group by rollup(cause, county)""", "sheets"))
def _(v):
    return workforce.totals_by_cause(v.sheets, with_rollup=True)


A3 = """select project_id, count(*) total_sigs, count(*) filter (coalesce(nullif(staff_override,''),status)='approved') valid_sigs,
  count(*) filter (signature_present) signed_sigs from signatures group by project_id"""


@query("a3_sheet_counts", with_ctes(A3, "signatures"))
def _(v):
    return workforce.sheet_counts(v.signatures)


@query("a4_j9_worker_header_totals", with_ctes("""
select worker_id, sum(total_lines) total_sigs, sum(approved) valid_sigs from assignments join headers using (project_id) group by 1""",
    "assignments", "headers"))
def _(v):
    return workforce.worker_header_totals(v.assignments, v.headers)


LINE_TOTALS = {"a3": A3, "lt": """select worker_id, sum(total_sigs) total_sigs, sum(valid_sigs) valid_sigs from assignments join a3 using (project_id) group by 1"""}


@query("a3_worker_line_totals", with_ctes("select * from lt", "assignments", "signatures", extra=LINE_TOTALS))
def _(v):
    return workforce.worker_line_totals(v.assignments, v.signatures)


@query("a5_total_valid", with_ctes("select coalesce(sum(approved),0) total_valid_sigs from headers", "headers"))
def _(v):
    return workforce.total_valid(v.headers)


@query("a6_daily_counts", with_ctes("select worker_id, strftime(created_at,'%Y-%m-%d') as day, sum(approved) day_sigs from entries group by 1,2", "entries"))
def _(v):
    return workforce.daily_counts(v.entries)


ALERTS = f"""select worker_id, full_name, project_id, county, cause, total_lines, fraud_flagged_lines,
  {round_py("fraud_flagged_lines/cast(greatest(total_lines,1) as double)*100", 1)} flagged_pct
  from sheets join assignments using (project_id) join workers using (worker_id) where fraud_flagged_lines/cast(greatest(total_lines,1) as double)*100>=30"""


@query("a8_j8_fraud_alerts", with_ctes(ALERTS, "sheets", "assignments", "workers"))
def _(v):
    return workforce.fraud_alerts(v.sheets, v.assignments, v.workers).select(
        "worker_id", "full_name", "project_id", "county", "cause", "total_lines", "fraud_flagged_lines", "flagged_pct")


@query("a8_alerts_per_worker", with_ctes("""
select worker_id, full_name, count(*) sheets, sum(fraud_flagged_lines) flagged_lines, sum(total_lines) total_lines, max(flagged_pct) worst_pct
from al group by 1,2""", "sheets", "assignments", "workers", extra={"al": ALERTS}))
def _(v):
    return workforce.alerts_per_worker(workforce.fraud_alerts(v.sheets, v.assignments, v.workers))


FIRST_BY_NAME = """select * from workers qualify row_number() over (partition by lower(trim(full_name)) order by case when is_active then 0 else 1 end, worker_id)=1"""


@query("w2_one_per_name", with_ctes(f"select worker_id, full_name, role from ({FIRST_BY_NAME}) q", "workers"))
def _(v):
    return workforce.one_per_name(v.workers).select("worker_id", "full_name", "role")


@query("w2_one_per_name_and_role", with_ctes("""
select worker_id, full_name, role from workers qualify row_number() over (partition by lower(trim(full_name)), role order by case when is_active then 0 else 1 end, worker_id)=1""", "workers"))
def _(v):
    return workforce.one_per_name(v.workers, with_role=True).select("worker_id", "full_name", "role")


@query("w1_leaderboard", with_ctes(f"""
select worker_id, full_name, valid_sigs, total_sigs, {round_py('case when total_sigs>0 then valid_sigs/total_sigs::double*100.0 else 0.0 end',1)} validity_rate,
  {round_py('hours',2)} total_hours, {round_py('case when hours>0 then valid_sigs/hours else 0.0 end',2)} sigs_per_hour,
  {round_py('case when valid_sigs>0 then round_even(hours*hourly_wage*100,0)/valid_sigs else 0.0 end',2)} cost_per_sig_cents,
  case when hours<=0 then 'No shifts' when valid_sigs/hours>=20 then 'Top Performer' when valid_sigs/hours>=15 then 'Gold' when valid_sigs/hours>=10 then 'Silver'
    when valid_sigs/hours>=5 then 'Bronze' else 'Starting' end tier_label,
  worker_id in (select worker_id from shifts where clock_out is null) is_clocked_in,
  row_number() over (order by valid_sigs desc, worker_id) as rank
from (select p.*, coalesce(t.total_sigs,0) total_sigs, coalesce(t.valid_sigs,0) valid_sigs, coalesce(us,0)/1e6/3600.0 as hours
  from ({FIRST_BY_NAME}) p left join (select worker_id, sum(total_lines) total_sigs, sum(approved) valid_sigs from assignments join headers using (project_id) group by 1) t using (worker_id)
  left join (select worker_id, sum({HOURS}) us from shifts where clock_out is not null group by 1) s using (worker_id)
  where is_active and role not in ('boss','admin')) z""", "workers", "assignments", "headers", "shifts"))
def _(v):
    totals = workforce.worker_header_totals(v.assignments, v.headers)
    return workforce.leaderboard(v.workers, totals, v.shifts)


@query("w3_open_shifts", with_ctes("""
select worker_id, shift_id, clock_in from shifts where clock_out is null qualify row_number() over (partition by worker_id order by clock_in desc, shift_id desc)=1""", "shifts"))
def _(v):
    return workforce.open_shifts(v.shifts).select("worker_id", "shift_id", "clock_in")


@query("w16_shifts_of_day", with_ctes("""
select worker_id, shift_id, clock_in, row_number() over (partition by worker_id order by clock_in, shift_id) n
from shifts where clock_in>=timestamp '2024-01-20 00:00:00'""", "shifts"))
def _(v):
    return workforce.shifts_from(v.shifts, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("worker_id", "shift_id", "clock_in", "n")


@query("j12_names", with_ctes(f"""
select shift_id, coalesce(full_name,'') worker_name, {round_py(H,2)} as hours, coalesce(full_name,'Worker '||cast(worker_id as varchar)) pin_name
from shifts left join (select * from workers where is_active) w using (worker_id)""", "shifts", "workers"))
def _(v):
    some = v.workers.where("is_active")
    named = workforce.named_shifts(v.shifts, some)
    return workforce.with_name(named.drop("worker_name"), some, "Worker").withColumnRenamed("worker_name", "pin_name").join(
        named.select("shift_id", F.col("worker_name")), "shift_id").select("shift_id", "worker_name", "hours", "pin_name")


@query("j14_shifts_in_periods", with_ctes("""
select shift_id, pay_period_id from shifts join pay_periods on clock_in between cast(start_date as timestamp) and cast(end_date as timestamp)+interval '86399 seconds'""",
    "shifts", "pay_periods"))
def _(v):
    return workforce.in_periods(v.shifts, v.pay_periods).select("shift_id", "pay_period_id")


@query("w15_current_period", with_ctes("select * from pay_periods order by status='open' desc, pay_period_id desc limit 1", "pay_periods"))
def _(v):
    return workforce.current_period(v.pay_periods)


PAY = {
    **LINE_TOTALS,
    "done": f"""select s.*, hourly_wage, strftime(clock_in,'%Y-%m-%d') as day, {HOURS} us from shifts s join workers using (worker_id)
        where is_active and clock_out is not null and clock_in between timestamp '{PERIOD[1]}' and timestamp '{PERIOD[2]} 23:59:59'""",
    "daily": f"""select worker_id, strftime(created_at,'%Y-%m-%d') as day, sum(approved) day_sigs from entries
        where created_at between timestamp '{PERIOD[1]}' and timestamp '{PERIOD[2]} 23:59:59' group by 1,2""",
    "sp": """select d.*, us/1e6/3600.0 h, tot/1e6/3600.0 th, coalesce(day_sigs,0) ds, worker_id in (select worker_id from daily) hd, coalesce(valid_sigs,0) vs
        from (select *, sum(us) over (partition by worker_id) tot from done) d left join daily using (worker_id, day) left join lt using (worker_id)""",
    "paid": f"""select {PERIOD[0]}::bigint pay_period_id, worker_id, shift_id, day, is_weekend, approved, us, {round_py('h',2)} as hours, ds day_sigs, wage wage_used,
        cast(round_even(h*wage*100,0) as bigint) base_pay_cents, cr valid_sigs_attributed,
        case when is_weekend then case when cr>=160 then 12000 when cr>=140 then 8000 when cr>=120 then 4000 else 0 end
          else case when cr>=80 then 6000 when cr>=70 then 4000 when cr>=60 then 2000 else 0 end end bonus_cents,
        case when is_weekend then cr>=160 or cr between 100 and 119 else cr>=80 or cr between 50 and 59 end earns_lunch
        from (select *, case when (case when hd then ds>=10 else (case when th>0 then vs/th else 0 end)>=10 end) then hourly_wage else least(hourly_wage,20.0) end wage,
          case when hd then ds when th>0 then cast(round_even(vs*h/th,0) as bigint) else 0 end cr from sp) q""",
    "rec": f"""select {PERIOD[0]}::bigint pay_period_id, worker_id, full_name, {round_py('h',2)} total_hours, ts total_signatures, vs valid_signatures,
        {round_py('case when ts>0 then vs/ts::double*100.0 else 0.0 end',1)} validity_rate, {round_py('case when h>0 then vs/h else 0.0 end',2)} sigs_per_hour,
        {round_py('case when h>0 then bp/100.0::double/h else hourly_wage end',2)} hourly_wage_used, bp base_pay_cents, bo bonus_cents, lunch earns_lunch, bp+bo gross_cents,
        cast(round_even((bp+bo)*0.313::double,0) as bigint) tax_cents, bp+bo-cast(round_even((bp+bo)*0.313::double,0) as bigint) net_cents
        from (select w.*, coalesce(u,0)/1e6/3600.0 h, coalesce(total_sigs,0) ts, coalesce(valid_sigs,0) vs, coalesce(b,0) bp, coalesce(o,0) bo, coalesce(l,false) lunch
          from workers w left join (select worker_id, sum(us)::bigint u, sum(base_pay_cents)::bigint b, sum(bonus_cents)::bigint o, bool_or(earns_lunch) l from paid group by 1) p using (worker_id)
          left join lt using (worker_id) where is_active) z""",
}
PAY_VIEWS = ("shifts", "workers", "entries", "assignments", "signatures")


def paid(v: Views):
    lt = workforce.worker_line_totals(v.assignments, v.signatures)
    return workforce.shift_pay(v.workers, v.shifts, lt, v.entries, *PERIOD), lt


@query("j15_m6_shift_pay", with_ctes("select * exclude (us) from paid", *PAY_VIEWS, extra=PAY))
def _(v):
    return paid(v)[0].drop("micros")


@query("a15_m7_pay_run", with_ctes("select * from rec", *PAY_VIEWS, extra=PAY))
def _(v):
    p, lt = paid(v)
    return workforce.pay_run(v.workers, p, lt, PERIOD[0])


@query("a14_pay_totals", with_ctes("""
select pay_period_id, count(*) workers_processed, sum(gross_cents)::bigint total_gross_cents, sum(net_cents)::bigint total_net_cents from rec group by 1""", *PAY_VIEWS, extra=PAY))
def _(v):
    p, lt = paid(v)
    return workforce.pay_totals(workforce.pay_run(v.workers, p, lt, PERIOD[0]))


@query("a14_profit_and_loss", with_ctes(f"""
select g total_labor_gross_cents, n total_labor_net_cents, vs total_valid_signatures, {round_py('h',2)} total_hours,
  {round_py('case when vs>0 then g/vs::double else 0.0 end',2)} cost_per_sig_cents, {round_py('case when h>0 then g/h else 0.0 end',2)} cost_per_hour_cents,
  90000000::bigint revenue_cents, 90000000-g margin_cents, {round_py('(90000000-g)/90000000.0::double*100',1)} margin_pct, wc worker_count
from (select sum(gross_cents)::bigint g, sum(net_cents)::bigint n, sum(valid_signatures)::bigint vs, sum(total_hours::decimal(18,2))::double h, count(distinct worker_id) wc from rec) q""", *PAY_VIEWS, extra=PAY))
def _(v):
    p, lt = paid(v)
    return workforce.profit_and_loss(workforce.pay_run(v.workers, p, lt, PERIOD[0]), 90000000)


@query("a20_tier_progress", with_ctes("""
select worker_id, a avg_sigs, case when a>=80 then '$60 bonus + lunch' when a>=70 then '$40 bonus' when a>=60 then '$20 bonus' when a>=50 then 'Free lunch' when a>=40 then 'Base pay' else 'Below threshold' end tier,
  case when a>=80 then null when a>=70 then 80 when a>=60 then 70 when a>=50 then 60 when a>=40 then 50 else 40 end next_at,
  cast(floor(case when a>=80 then 100.0 when a>=40 then (a%10)*10.0 else a/40.0*100 end+0.5) as bigint) progress_pct
from (select worker_id, case when coalesce(k,0)>0 then cast(floor(valid_signatures/k::double+0.5) as bigint) else 0 end a
  from rec left join (select worker_id, count(*) k from paid group by 1) s using (worker_id)) q""", *PAY_VIEWS, extra=PAY))
def _(v):
    p, lt = paid(v)
    return workforce.tier_progress(workforce.pay_run(v.workers, p, lt, PERIOD[0]), p.groupBy("worker_id").agg(F.count(F.lit(1)).alias("shifts")))


@query("x1_pay_json", with_ctes("""
select worker_id, shift_id, printf('{"shift_id":%d,"worker_id":%d,"base_pay_cents":%d,"bonus_cents":%d}', shift_id, worker_id, base_pay_cents, bonus_cents) json from paid""", *PAY_VIEWS, extra=PAY))
def _(v):
    p, _lt = paid(v)
    return p.select("worker_id", "shift_id", F.to_json(F.struct("shift_id", "worker_id", "base_pay_cents", "bonus_cents")).alias("json"))


@query("a16_worker_cards", with_ctes(f"""
select worker_id, full_name, role, o.shift_id is not null is_clocked_in, o.clock_in clock_in_time, {round_py('coalesce(us,0)/1e6/3600.0',2)} today_hours,
  coalesce(total_sigs,0) total_sigs, coalesce(valid_sigs,0) valid_sigs,
  {round_py('case when coalesce(total_sigs,0)>0 then valid_sigs/total_sigs::double*100.0 else 0.0 end',1)} validity_rate,
  cast(round_even(coalesce(us,0)/1e6/3600.0*hourly_wage*100,0) as bigint) estimated_pay_cents
from (select * from workers where role not in ('boss') qualify row_number() over (partition by lower(trim(full_name)), role order by case when is_active then 0 else 1 end, worker_id)=1) p
left join op o using (worker_id) left join (
  select worker_id, sum(case when clock_out is not null then epoch_us(s.clock_out)-epoch_us(s.clock_in) when s.shift_id=op.shift_id then epoch_us(timestamp '{AS_OF}')-epoch_us(s.clock_in) else 0 end) us
  from shifts s left join op using (worker_id) where s.clock_in>=timestamp '2024-01-20' group by 1) t using (worker_id)
left join (select worker_id, sum(total_lines) total_sigs, sum(approved) valid_sigs from assignments join headers using (project_id) group by 1) c using (worker_id)""",
    "workers", "shifts", "assignments", "headers",
    extra={"op": "select worker_id, shift_id, clock_in from shifts where clock_out is null qualify row_number() over (partition by worker_id order by clock_in desc, shift_id desc)=1"}))
def _(v):
    return workforce.worker_cards(v.workers, workforce.worker_header_totals(v.assignments, v.headers), v.shifts,
                                  F.lit(AS_OF).cast("timestamp_ntz"))


@query("j18_worker_sheets", with_ctes("""
select worker_id, project_id, coalesce(total_sigs,0) total_sigs, coalesce(valid_sigs,0) valid_sigs, coalesce(signed_sigs,0) signed_sigs,
  row_number() over (partition by worker_id order by assigned_at desc, project_id) place from assignments left join a3 using (project_id)""", "assignments", "signatures", extra={"a3": A3}))
def _(v):
    return workforce.worker_sheets(v.assignments, v.signatures).select("worker_id", "project_id", "total_sigs", "valid_sigs", "signed_sigs", "place")


@query("j18_own_team", with_ctes("""
select w.worker_id, role, t.team_id own_team_id, t.team_name from workers w join teams t on t.team_id=
  case when role in ('field_manager','boss','admin') then (select min(team_id) from teams x where x.manager_id=w.worker_id) else w.team_id end""", "workers", "teams"))
def _(v):
    return workforce.own_team(v.workers, v.teams)


@query("p3_shift_list", with_ctes("""
select shift_id, worker_id, clock_in from shifts where clock_in>=timestamp '2024-01-05' and clock_in<=timestamp '2024-01-12'""", "shifts"))
def _(v):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 00:00:00"))
    return tables.listed(v.shifts, {"worker_id": None}, "clock_in", lo, hi, [F.desc("clock_in"), "shift_id"]).select("shift_id", "worker_id", "clock_in")


@query("p4_people_list", with_ctes("select worker_id, full_name from workers where role='worker'", "workers"))
def _(v):
    return tables.listed(v.workers, {"role": "worker", "team_id": None}, order=["full_name", "worker_id"]).select("worker_id", "full_name")


@query("p5_visible_rows", with_ctes("""
select w.worker_id viewer_id, project_id from workers w join assignments a using (worker_id) where role not in ('field_manager','boss')""", "workers", "assignments"))
def _(v):
    viewers = v.workers.select(F.col("worker_id").alias("viewer_id"), F.col("role").isin("field_manager", "boss").alias("is_reviewer"))
    return tables.visible_to(v.assignments, viewers).select("viewer_id", "project_id")


@query("p8_find_by_name", with_ctes("""
select worker_id, full_name, role from workers where is_active qualify row_number() over (partition by lower(full_name)
  order by case role when 'boss' then 0 when 'admin' then 1 when 'field_manager' then 2 when 'office_worker' then 3 when 'worker' then 4 else 9 end, worker_id)=1""", "workers"))
def _(v):
    wanted = v.workers.select(F.concat(F.lit(" "), F.upper("full_name")).alias("wanted_name"))
    return workforce.find_by_name(v.workers, wanted).select("worker_id", "full_name", "role")


@query("p9_unassigned", with_ctes("select worker_id, full_name from workers where team_id is null and is_active and role in ('petitioner','worker','office_worker')", "workers"))
def _(v):
    return workforce.unassigned(v.workers).select("worker_id", "full_name")


@query("active_people", with_ctes("""
select worker_id, full_name, case role when 'worker' then 'Worker' when 'petitioner' then 'Petitioner' when 'office_worker' then 'Staff' end role_label
from workers where is_active and role not in ('boss','admin','field_manager') qualify row_number() over (partition by lower(trim(full_name)) order by worker_id)=1""", "workers"))
def _(v):
    return workforce.active_people(v.workers)


LATEST = {"lc": "select worker_id, sig_count from live_events qualify row_number() over (partition by worker_id order by ts desc, event_id desc)=1",
          "lp": "select worker_id, lat, lng from pins qualify row_number() over (partition by worker_id order by ts desc, event_id desc)=1"}


@query("st1_latest_counts", with_ctes("select * from lc", "live_events", extra={"lc": LATEST["lc"]}))
def _(v):
    return workforce.latest_counts(v.live_events).select("worker_id", "sig_count")


@query("st2_latest_positions", with_ctes("select * from lp", "pins", extra={"lp": LATEST["lp"]}))
def _(v):
    return workforce.latest_positions(v.pins).select("worker_id", "lat", "lng")


@query("st3_live_total", with_ctes("select coalesce(sum(approved),0) total_valid_sigs from headers", "headers"))
def _(v):
    return live.total_valid_stream(v.headers)


@query("j10_live_overlay", with_ctes("""
select worker_id, coalesce(full_name,'') full_name, coalesce(sig_count,0) sig_count, lat, lng from lc full join lp using (worker_id)
left join (select * from workers where is_active) w using (worker_id) where (sig_count is not null and full_name is not null) or lat is not null""",
    "live_events", "pins", "workers", extra=LATEST))
def _(v):
    return workforce.live_overlay(workforce.latest_counts(v.live_events), workforce.latest_positions(v.pins), v.workers.where("is_active"))


@query("j13_team_members", with_ctes("""
select t.team_id, t.team_name, t.manager_id, w.worker_id, w.full_name, w.role, coalesce(sig_count,0) sig_count
from teams t left join workers w using (team_id) left join lc on lc.worker_id=w.worker_id""", "teams", "workers", "live_events", extra={"lc": LATEST["lc"]}))
def _(v):
    return workforce.team_members(v.teams, v.workers, workforce.latest_counts(v.live_events))


@query("j13_t4_team_leaderboard", with_ctes("""
select t.team_id, t.team_name, t.manager_id, count(w.worker_id) member_count, sum(coalesce(sig_count,0)) total_sigs, any_value(m.full_name) manager_name
from teams t left join workers w using (team_id) left join lc on lc.worker_id=w.worker_id left join workers m on m.worker_id=t.manager_id group by 1,2,3""",
    "teams", "workers", "live_events", extra={"lc": LATEST["lc"]}))
def _(v):
    return workforce.team_leaderboard(v.teams, v.workers, workforce.latest_counts(v.live_events))


PUNCH_SQL = """select worker_id, in_id shift_id, in_ts clock_in, ts clock_out from (
  select *, lag(kind) over w pk, last_value(case when kind='in' and coalesce(pk0,'out')='out' then event_id end ignore nulls) over (partition by worker_id order by ts, event_id rows between unbounded preceding and 1 preceding) in_id,
    last_value(case when kind='in' and coalesce(pk0,'out')='out' then ts end ignore nulls) over (partition by worker_id order by ts, event_id rows between unbounded preceding and 1 preceding) in_ts
  from (select *, lag(kind) over (partition by worker_id order by ts, event_id) pk0 from punches) p window w as (partition by worker_id order by ts, event_id)) q
  where kind='out' and pk='in'"""


@query("st4_clock_shifts", with_ctes(PUNCH_SQL, "punches"))
def _(v):
    return clock.pair_punches(v.punches)[0]


@query("st4_clock_verdicts", with_ctes("""
select worker_id, event_id, kind, case when kind='in' then case when coalesce(pk,'out')='out' then 'accepted' else 'already_in' end
  else case when pk='in' then 'accepted' else 'not_in' end end verdict
from (select *, lag(kind) over (partition by worker_id order by ts, event_id) pk from punches) p""", "punches"))
def _(v):
    return clock.pair_punches(v.punches)[1].drop("ts")


@query("s11_upsert_counts", with_ctes("""
select worker_id, sig_count from (select worker_id, 0 sig_count from workers union all select worker_id, sig_count from lc) u
qualify row_number() over (partition by worker_id order by (worker_id in (select worker_id from lc) and sig_count>=0)::int desc, sig_count desc)=1""",
    "workers", "live_events", extra={"lc": LATEST["lc"]}).replace("order by (worker_id in (select worker_id from lc) and sig_count>=0)::int desc, sig_count desc", "order by sig_count desc"))
def _(v):
    base = v.workers.select("worker_id", F.lit(0).cast("bigint").alias("sig_count"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("bigint").alias("event_id"))
    return tables.upsert(base, v.live_events.select(*base.columns), ["worker_id"], ["ts", "event_id"]).select("worker_id", "sig_count")


@query("s12_patch_shifts", with_ctes("""
select shift_id, case when shift_id%3=1 then true else approved end approved, case when shift_id%3=1 then null else is_weekend end is_weekend from shifts""", "shifts"))
def _(v):
    changes = v.shifts.where("shift_id % 3 = 1").select("shift_id", F.lit(True).alias("approved"), F.lit(None).cast("boolean").alias("is_weekend"))
    return tables.patch(v.shifts, changes, ["shift_id"], ["approved", "is_weekend"]).select("shift_id", "approved", "is_weekend")


@query("s13_reassign", with_ctes("""
select project_id, case when project_id%4=0 then worker_id+1 else worker_id end worker_id from assignments""", "assignments"))
def _(v):
    later = v.assignments.where("project_id % 4 = 0").select("project_id", (F.col("worker_id") + 1).alias("worker_id"),
                                                             F.date_add("assigned_at", 1).cast(dict(v.assignments.dtypes)["assigned_at"]).alias("assigned_at"))
    return tables.reassign(v.assignments, later, ["assigned_at", "worker_id"]).select("project_id", "worker_id")


@query("s14_expand_hand_counts", with_ctes("""
select project_id, i line_number, 'Manual entry '||cast(i as varchar) raw_name, 'approved' status
from (select project_id, unnest(range(1, sig_count+1)) i from hand_counts where sig_count>=1) q""", "hand_counts"))
def _(v):
    return tables.expand_counts(v.hand_counts)[1].select("project_id", "line_number", "raw_name", "status")


@query("s15_drop_duplicate_people", with_ctes("""
select shift_id, worker_id from shifts where worker_id in (
  select worker_id from workers qualify row_number() over (partition by lower(trim(full_name)), role order by worker_id)=1)""", "shifts", "workers"))
def _(v):
    out = tables.drop_duplicate_people(v.workers, {"shifts": v.shifts}, [workforce.name_key(), F.col("role")], [F.col("worker_id")])
    return out["shifts"].select("shift_id", "worker_id")


@query("t1_newest_pins", with_ctes("select event_id, worker_id, lat, lng from pins order by ts desc, event_id limit 200", "pins"))
def _(v):
    return tables.listed(v.pins, order=[F.desc("ts"), "event_id"], limit=200).select("event_id", "worker_id", "lat", "lng")
