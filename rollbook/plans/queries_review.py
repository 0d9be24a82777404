"""Sheet scans, packet scores, review state, field quality, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..operators import linkage, packet_rules, quality, sheet_rules, tables
from ..session import cut
from ..sources import files, roll
from .oracle_views import may_reach, ratio_ctes, round_py, sequence_ctes, sorted_tokens, with_ctes
from .queries_linkage import pasted
from .registry import query

ROLL_LINES = 100  # at most, of a pasted text
from .views import Views

K = ["project_id", "line_number"]


def norm(v: Views):
    return linkage.normalize_lines(v.lines)


# ── sheet scan ───────────────────────────────────────────────────────────────

@query("r1_blank_lines", with_ctes("select project_id, line_number from lines where raw_name='' and raw_address=''", "lines"))
def _(v):
    return sheet_rules.blank_lines(v.lines).select(*K)


@query("r2_no_signature", with_ctes("select project_id, line_number from lines where (raw_name<>'' or raw_address<>'') and not signature_present", "lines"))
def _(v):
    return sheet_rules.unsigned_lines(v.lines).select(*K)


CITY = """select project_id, city, n from (select *, sum(n) over (partition by project_id) tot from
  (select project_id, city, count(*) n from {src} group by 1,2) q) z where city<>'' and tot>=4 and n/cast(tot as double)>={at}"""
# Sheets as printed never share one city; a coarser grouping stands in for it.
COARSE = "select *, case when project_id%3=0 and line_number%5<>0 then 'nation' else raw_city end city from (select *, trim(split_part(raw_address,',',2)) raw_city from lines where raw_name<>'' or raw_address<>'') q"


@query("r3_a9_same_city", with_ctes("""
select c.project_id, line_number, c.city shared, d.n n_lines from coarse c join dom d on d.project_id=c.project_id and d.city=c.city""",
    "lines", extra={"coarse": COARSE, "dom": CITY.format(src="coarse", at=0.7)}))
def _(v):
    coarse = F.when((F.col("project_id") % 3 == 0) & (F.col("line_number") % 5 != 0) & (F.col("raw_name") != ""), "nation").otherwise(F.col("city"))
    return sheet_rules.same_city(norm(v).withColumn("city", coarse)).select(*K, "shared", "n_lines")


@query("r7_a11_same_date", with_ctes("""
select project_id, line_number, k.dt shared, n n_lines from k join (select project_id, count(*) n, count(distinct dt) d from k group by 1) g using (project_id) where n>=4 and d=1""",
    "lines", extra={"k": "select project_id, line_number, case when project_id%4=0 then '19960101' else replace(raw_date,'-','') end dt from lines where raw_name<>'' or raw_address<>''"}))
def _(v):
    stamped = F.when(F.col("project_id") % 4 == 0, "1996/01/01").otherwise(F.col("raw_date"))
    return sheet_rules.same_date(v.lines.withColumn("raw_date", stamped)).select(*K, "shared", "n_lines")


# House numbers squeezed to a shared street, so that neighbours and runs occur.
NUMBERED = """select project_id, line_number, (cast(split_part(raw_address,' ',1) as bigint)//7)%40 num, split_part(raw_address,' ',2) road from lines where raw_address<>''"""


def squeezed(v: Views):
    num = (F.floor(F.split_part("raw_address", F.lit(" "), F.lit(1)).try_cast("bigint") / 7) % 40).cast("string")
    return v.lines.withColumn("raw_address", F.when(F.col("raw_address") == "", "").otherwise(
        F.concat(num, F.lit(" "), F.split_part("raw_address", F.lit(" "), F.lit(2)))))


@query("r4_w6_nearby_address", with_ctes("""
select a.project_id, a.line_number, coalesce(min(struct_pack(n:=b.num, l:=b.line_number)) filter (b.num<a.num), min(struct_pack(n:=b.num, l:=b.line_number)) filter (b.num>a.num)).l partner_line
from k a join k b on a.project_id=b.project_id and a.road=b.road and a.num<>b.num and abs(a.num-b.num)<=10 group by 1,2""", "lines", extra={"k": NUMBERED}))
def _(v):
    return sheet_rules.address_rules(squeezed(v)).where(F.col("code") == sheet_rules.NEARBY_ADDRESS).select(*K, "partner_line")


RUNS = {"k": NUMBERED, "s": """select *, lead(num,1) over w n1, lead(num,2) over w n2, lead(num,3) over w n3, lead(line_number,1) over w l1,
    lead(line_number,2) over w l2, lead(line_number,3) over w l3 from k window w as (partition by project_id, road order by num, line_number)""",
    "hit": "select project_id, num, unnest([line_number,l1,l2,l3]) line_number, [line_number,l1,l2,l3] run from s where n1=num+1 and n2=num+2 and n3=num+3",
    "run1": "select * from hit qualify row_number() over (partition by project_id, line_number order by num)=1"}


@query("r4_w4_consecutive_addresses", with_ctes("""
select project_id, line_number, array_to_string(list_filter(run, lambda x: x<>line_number),',') shared from run1""", "lines", extra=RUNS))
def _(v):
    return sheet_rules.address_rules(squeezed(v)).where(F.col("code") == sheet_rules.CONSECUTIVE).select(*K, "shared")


def partner_sql(text: str, t: int) -> dict[str, str]:
    return {"k": f"select project_id, line_number, {sorted_tokens(text)} t from norm where trim({text})<>''",
            "pp": f"select i.project_id, i.line_number li, j.line_number lj, i.t a, j.t b from k i join k j on i.project_id=j.project_id and i.line_number<j.line_number and {may_reach('i.t','j.t',t)}",
            "pr": "select a, b from pp", **ratio_ctes("rt", "pr"),
            "hp": f"select project_id, li, lj from pp join rt using (a,b) where ratio>={t}",
            "pt": "select project_id, line_number, min(partner_line) partner_line from (select project_id, li line_number, lj partner_line from hp union all select project_id, lj, li from hp) q group by 1,2"}


@query("r5_duplicate_name", with_ctes("select * from pt", "norm", extra=partner_sql("first_name||' '||last_name", 92)))
def _(v):
    return sheet_rules.duplicate_names(norm(v)).select(*K, "partner_line")


@query("r6_duplicate_address", with_ctes("select * from pt", "norm", extra=partner_sql("street", 88)))
def _(v):
    return sheet_rules.duplicate_addresses(norm(v)).select(*K, "partner_line")


def vector_lines(v: Views):
    return v.vectors.select("project_id", F.col("vec_id").cast("int").alias("line_number"), F.col("v").alias("handwriting_vector"),
                            F.when(F.col("vec_id") % 400 == 0, F.array((F.col("vec_id") + 1).cast("int"), (F.col("vec_id") + 2).cast("int"))).alias("same_handwriting_as"))


@query("r8_u1_same_handwriting", with_ctes("""
select project_id, line_number, min(partner) partner_line from (
  select project_id, line_number, partner from said where line_number in (select vec_id from vectors)
  union all select project_id, li, lj from near where project_id not in (select project_id from said)
  union all select project_id, lj, li from near where project_id not in (select project_id from said)) q group by 1,2""", "vectors",
    extra={"said": """select project_id, vec_id line_number, vec_id+k partner from vectors, (select unnest([1,2]) k) where vec_id%400=0
             union select project_id, vec_id+k, vec_id from vectors, (select unnest([1,2]) k) where vec_id%400=0""",
           "d": "select project_id, vec_id, v::double[] v, sqrt(list_dot_product(v::double[],v::double[])) m from vectors",
           "near": "select a.project_id, a.vec_id li, b.vec_id lj from d a join d b on a.project_id=b.project_id and a.vec_id<b.vec_id where list_dot_product(a.v,b.v)/(a.m*b.m+1e-9)>=0.97"}))
def _(v):
    return sheet_rules.same_handwriting(vector_lines(v)).select(*K, "partner_line")


@query("a7_scan_summary", with_ctes("""
select l.project_id, count(*) total_lines, count(*) filter (raw_name='' and raw_address='') blank_lines, count(*) filter (s.line_number is not null) suspicious_lines,
  count(*)-count(*) filter (raw_name='' and raw_address='') filled_lines,
  count(*)-count(*) filter (raw_name='' and raw_address='')-count(*) filter (s.line_number is not null) clean_lines,
  count(*) filter ((raw_name<>'' or raw_address<>'') and not signature_present) no_signature, count(pt.line_number) duplicate_name
from lines l left join pt on pt.project_id=l.project_id and pt.line_number=l.line_number
left join (select project_id, line_number from lines where (raw_name<>'' or raw_address<>'') and not signature_present union select project_id, line_number from pt) s
  on s.project_id=l.project_id and s.line_number=l.line_number group by 1""", "norm", extra=partner_sql("first_name||' '||last_name", 92)))
def _(v):
    n = cut(norm(v))
    flags = sheet_rules.blank_lines(n).unionByName(sheet_rules.unsigned_lines(n)).unionByName(sheet_rules.duplicate_names(n))
    out = sheet_rules.scan_summary(n, flags)
    count = lambda c: F.coalesce(F.try_element_at(F.col("flag_counts"), F.lit(c)), F.lit(0)).cast("bigint").alias(c)
    return out.select("project_id", "total_lines", "blank_lines", "suspicious_lines", "filled_lines", "clean_lines", count("no_signature"), count("duplicate_name"))


# ── packet rules ─────────────────────────────────────────────────────────────

PK = ["packet_id", "line_no"]


def counties(v: Views):
    return v.projects.select(F.col("project_id").alias("packet_id"), "county")


@query("k1_no_signature", with_ctes("select packet_id, line_no from packet_lines where row_status='new_signature' and not has_signature", "packet_lines"))
def _(v):
    return packet_rules.unsigned_rows(v.packet_lines).select(*PK)


@query("k2_invalid_zip", with_ctes("select packet_id, line_no from packet_lines where raw_zip<>'' and not valid_zip", "packet_lines"))
def _(v):
    return packet_rules.invalid_zips(v.packet_lines).select(*PK)


@query("k3_j11_city_not_in_county", with_ctes("""
select packet_id, line_no, 'city_not_in_'||replace(lower(county),' ','_')||'_county' flag from packet_lines join projects on project_id=packet_id
where row_status<>'blank' and raw_name<>'' and county<>'' and raw_city<>'' and not exists (select 1 from county_cities c where c.county=projects.county and c.city=raw_city)""",
    "packet_lines", "projects", "county_cities"))
def _(v):
    return packet_rules.foreign_cities(v.packet_lines, counties(v), v.county_cities).select(*PK, "flag")


CHAIN = """select packet_id, line_no from (select *, count(*) over (partition by packet_id, city, chain) rows_ from
  (select *, sum(cut) over (partition by packet_id, city order by num, line_no rows unbounded preceding) chain from
    (select *, case when num-lag(num) over (partition by packet_id, city order by num, line_no)<=6 then 0 else 1 end cut from
      (select packet_id, line_no, lower(trim(raw_city)) city, try_cast(regexp_extract(trim(raw_address),'^(\\d+)',1) as bigint) num from packet_lines
       where row_status<>'blank' and raw_name<>'') a where num is not null) b) c) d where rows_>=3"""


@query("k4_w5_near_sequences", with_ctes(CHAIN.replace("lower(trim(raw_city)) city", "'city '||(length(raw_city)%3) city"), "packet_lines"))
def _(v):
    few = F.concat(F.lit("city "), F.length("raw_city") % 3)  # few cities, so that each has many house numbers
    return packet_rules.near_sequences(v.packet_lines.withColumn("raw_city", few)).select(*PK)


@query("k5_w7_long_city_run", with_ctes("""
select packet_id, line_no from (select *, count(*) over (partition by packet_id, grp, city) n from
  (select *, row_number() over (partition by packet_id order by line_no)-row_number() over (partition by packet_id, city order by line_no) grp from
    (select packet_id, line_no, case when packet_id%3=0 and line_no%9<>0 then 'x' else raw_city end city from packet_lines where row_status<>'blank' and raw_name<>'') a) b) c where n>=5""", "packet_lines"))
def _(v):
    near = F.when((F.col("packet_id") % 3 == 0) & (F.col("line_no") % 9 != 0), "X").otherwise(F.col("raw_city"))
    return packet_rules.city_runs(v.packet_lines.withColumn("raw_city", near), chunk_rows=8).select(*PK)


@query("k6_a10_uniform_date", with_ctes("""
select packet_id, line_no from k join (select * from (select *, sum(n) over (partition by packet_id) tot from (select packet_id, dt, count(*) n from k group by 1,2) a) b
  where tot>=4 and n/cast(tot as double)>=0.7) g using (packet_id, dt)""", "packet_lines",
    extra={"k": "select packet_id, line_no, case when packet_id%5=0 and line_no%4<>0 then '1996-01-01' else raw_date end dt from packet_lines where row_status<>'blank' and raw_name<>''"}))
def _(v):
    stamped = F.when((F.col("packet_id") % 5 == 0) & (F.col("line_no") % 4 != 0), "1996-01-01").otherwise(F.col("raw_date"))
    return packet_rules.uniform_dates(v.packet_lines.withColumn("raw_date", stamped)).select(*PK)


NAMESAKES = {
    "who": "select packet_id, line_no, upper(case when norm_name<>'' then norm_name else raw_name end) who from packet_lines where row_status<>'blank' and raw_name<>''",
    "met": f"""select i.packet_id, i.line_no li, j.line_no lj, i.who a, j.who b from who i join who j on i.packet_id=j.packet_id and i.line_no<j.line_no
        and (i.who=j.who or {may_reach('i.who', 'j.who', 88)})""",
    **sequence_ctes("wr", "met"),
    "namesakes": "select distinct packet_id, unnest([li, lj]) line_no from met join wr using (a, b) where ratio>=0.88::double",
}


@query("k7_similar_names", with_ctes("select packet_id, line_no from namesakes", "packet_lines", extra=NAMESAKES))
def _(v):
    return packet_rules.similar_names(v.packet_lines).select(*PK)


POINTED = """select packet_id, line_no, 'no_signature' flag, 30 points from packet_lines where row_status='new_signature' and not has_signature
  union all select packet_id, line_no, 'invalid_zip', 15 from packet_lines where raw_zip<>'' and not valid_zip
  union all select packet_id, line_no, 'city_not_in_'||replace(lower(county),' ','_')||'_county', 80 from packet_lines join projects on project_id=packet_id
    where row_status<>'blank' and raw_name<>'' and county<>'' and raw_city<>'' and not exists (select 1 from county_cities c where c.county=projects.county and c.city=raw_city)
  union all select packet_id, line_no, 'consecutive_addresses', 40 from chain"""


RUNS = """select packet_id, line_no from (select *, count(*) over (partition by packet_id, grp, city) n from
  (select *, row_number() over (partition by packet_id order by line_no)-row_number() over (partition by packet_id, city order by line_no) grp from
    (select packet_id, line_no, lower(trim(raw_city)) city from packet_lines where row_status<>'blank' and raw_name<>'') a) b) c where n>=5"""
DATED = """select packet_id, line_no from d join (select *, sum(n) over (partition by packet_id) tot from (select packet_id, raw_date, count(*) n from d group by 1,2) a) g
  using (packet_id, raw_date) where tot>=4 and n/cast(tot as double)>=0.7"""


@query("k8_packet_scores", with_ctes("""
select packet_id, line_no, coalesce(fraud_flags,'') fraud_flags, least(100, coalesce(points,0))::int fraud_score from packet_lines left join
  (select packet_id, line_no, string_agg(flag,'|' order by flag) fraud_flags, sum(points) points from pts group by 1,2) q using (packet_id, line_no)""",
    "packet_lines", "projects", "county_cities", extra={"chain": CHAIN, **NAMESAKES, "runs": RUNS,
    "d": "select packet_id, line_no, raw_date from packet_lines where row_status<>'blank' and raw_name<>'' and raw_date<>''", "dated": DATED,
    "pts": POINTED + """ union all select packet_id, line_no, 'long_city_run', 20 from runs union all select packet_id, line_no, 'similar_name', 35 from namesakes
      union all select packet_id, line_no, 'uniform_date', 15 from dated"""}))
def _(v):
    lines = cut(v.packet_lines)
    out = packet_rules.score_packets(lines, packet_rules.packet_flags(lines, counties(v), v.county_cities))
    return out.select(*PK, F.array_join("fraud_flags", "|").alias("fraud_flags"), "fraud_score")


@query("k8_scores_of_native_rules", with_ctes("""
select packet_id, line_no, coalesce(fraud_flags,'') fraud_flags, least(100, coalesce(points,0))::int fraud_score from packet_lines left join
  (select packet_id, line_no, string_agg(flag,'|' order by flag) fraud_flags, sum(points) points from pts group by 1,2) q using (packet_id, line_no)""",
    "packet_lines", "projects", "county_cities", extra={"chain": CHAIN, "pts": POINTED}))
def _(v):
    lines = cut(v.packet_lines)
    flags = (packet_rules.unsigned_rows(lines).unionByName(packet_rules.invalid_zips(lines))
             .unionByName(packet_rules.foreign_cities(lines, counties(v), v.county_cities)).unionByName(packet_rules.near_sequences(lines)))
    return packet_rules.score_packets(lines, flags).select(*PK, F.array_join("fraud_flags", "|").alias("fraud_flags"), "fraud_score")


@query("u2_x2_merge_outside_flags", with_ctes("""
select packet_id, line_no, case when line_no%4<>0 then flags when flags='' then 'copied_hand' else flags||'|copied_hand' end fraud_flags,
  case when line_no%4=0 then least(100, greatest(fraud_score, line_no*3)) else fraud_score end fraud_score
from (select *, case when line_no%10=0 then 'similar_name|invalid_zip' else '' end flags from packet_review) q""", "packet_review"))
def _(v):
    src = v.packet_review.withColumn("fraud_flags", vl.json_list_or_empty(F.col("fraud_flags")))
    outside = src.where("line_no % 4 = 0").select(*PK, F.when(F.col("line_no") % 10 == 0, F.array(F.lit("similar_name"), F.lit("copied_hand")))
                                                 .otherwise(F.array(F.lit("copied_hand"))).alias("flags"), (F.col("line_no") * 3).alias("score"))
    return packet_rules.merge_outside_flags(src, outside).select(*PK, F.array_join("fraud_flags", "|").alias("fraud_flags"), "fraud_score")


# ── review state ─────────────────────────────────────────────────────────────

@query("p1_effective_status", with_ctes("select project_id, line_number, coalesce(nullif(staff_override,''),status) status from signatures", "signatures"))
def _(v):
    return v.signatures.select(*K, packet_rules.effective_status(F.col("staff_override"), F.col("status")).alias("status"))


@query("p2_status_page", with_ctes("""
select project_id, line_number, rn, total from (select *, row_number() over (partition by project_id order by line_number) rn, count(*) over (partition by project_id) total
  from signatures where coalesce(nullif(staff_override,''),status)='approved') q where rn between 6 and 10""", "signatures"))
def _(v):
    ok = v.signatures.where(packet_rules.effective_status(F.col("staff_override"), F.col("status")) == "approved")
    return tables.page_of(ok, ["project_id"], ["line_number"], page=2, size=5).select(*K, "rn", "total")


APPROVABLE = """row_status='new_signature' and coalesce(action,'')='' and has_signature and ai_verdict<>'likely_invalid' and voter_status='valid'
  and coalesce(flags_json,'')in('','[]') and fraud_flags='[]' and fraud_score=0 and coalesce(review_decision,'')<>'confirmed_fraud'"""


@query("p6_approve_all", with_ctes(f"select packet_id, line_no, case when {APPROVABLE} then 'approved' else action end as action from packet_review", "packet_review"))
def _(v):
    return packet_rules.approve_all(v.packet_review).select(*PK, "action")


EXPORT = """select packet_id, line_no, raw_name as name, raw_address address, raw_city city, raw_zip zip, raw_date date, has_signature, voter_status,
  case when voter_confidence=0 then '' else cast(voter_confidence as varchar) end voter_confidence, voter_reason, fraud_score,
  case when line_no%10=0 then 'similar_name|invalid_zip' else '' end fraud_flags, coalesce(review_decision,'') review_decision, coalesce(action,'') as action from packet_review where """


def review(v: Views):
    return v.packet_review.withColumn("fraud_flags", vl.json_list_or_empty(F.col("fraud_flags")))


@query("p7_s8_export_all", with_ctes(EXPORT + "row_status<>'blank'", "packet_review"))
def _(v):
    return files.packet_export(review(v), "all")


@query("p7_s8_export_valid", with_ctes(EXPORT + "voter_status='valid' and coalesce(review_decision,'')<>'confirmed_fraud'", "packet_review"))
def _(v):
    return files.packet_export(review(v), "valid")


@query("p7_s8_export_flagged", with_ctes(EXPORT + "fraud_score>30 or review_decision='confirmed_fraud'", "packet_review"))
def _(v):
    return files.packet_export(review(v), "flagged")


@query("s7_export_lines", with_ctes("""
select project_id, line_number, raw_name, raw_address, raw_date, signature_present, coalesce(nullif(staff_override,''),status) status, status auto_status, '' staff_notes from signatures""", "signatures"))
def _(v):
    return files.line_export(v.signatures).select(*K, "raw_name", "raw_address", "raw_date", "signature_present", "status", "auto_status", "staff_notes")


@query("s9_result_json", with_ctes("""
select project_id, line_number, printf('{"project_id":%d,"line_number":%d,"status":"%s"}', project_id, line_number, status) json from signatures""", "signatures"))
def _(v):
    return files.result_json(v.signatures.select(*K, "status"), K)


@query("s10_replace_sheets", with_ctes("""
select project_id, line_number, raw_name from lines where project_id%6<>0 union all select project_id, line_number, upper(raw_name) from lines where project_id%6=0 and line_number<=10""", "lines"))
def _(v):
    base = v.lines.select(*K, "raw_name")
    again = base.where("project_id % 6 = 0 and line_number <= 10").withColumn("raw_name", F.upper("raw_name"))
    return tables.replace_by_key(base, again, "project_id")


@query("a12_packet_summary", with_ctes("""
select packet_id, count(*) total_rows, count(*) filter (row_status='new_signature') new_signatures, count(*) filter (row_status='already_counted') previously_counted,
  count(*) filter (row_status='changed_needs_review') needs_review, count(*) filter (row_status='blank') blank from packet_lines group by 1""", "packet_lines"))
def _(v):
    return packet_rules.packet_summary(v.packet_lines)


@query("a13_outcome_counts", with_ctes("""
select packet_id, count(voter_status) matched, count(*) filter (voter_status='valid') as valid, count(*) filter (voter_status='uncertain') uncertain,
  count(*) filter (voter_status='invalid') invalid, count(*) filter (fraud_score>0) flagged, count(*) filter (action='approved') approved
from (select * replace (case when """ + APPROVABLE + """ then 'approved' else action end as action) from packet_review) q group by 1""", "packet_review"))
def _(v):
    return packet_rules.outcome_counts(packet_rules.approve_all(v.packet_review))


@query("v4_first_verdict", with_ctes("select packet_id, line_no, ai_verdict from packet_review", "packet_review"))
def _(v):
    return v.packet_lines.select(*PK, packet_rules.first_verdict(F.col("row_status"), F.col("has_signature")).alias("ai_verdict"))


@query("v6_upload_status", with_ctes("select project_id, line_number, case when raw_name='' and raw_address='' then 'rejected' else 'review' end status from lines", "lines"))
def _(v):
    return v.lines.select(*K, linkage.upload_status(F.col("raw_name"), F.col("raw_address")).alias("status"))


@query("w9_fill_page_rows", with_ctes("""
select packet_id, line_no, coalesce(row_status,'blank') row_status from (select distinct packet_id, unnest(range(1,8)) line_no from pr) s
full join (select packet_id, row_number() over (partition by packet_id order by line_no) line_no, row_status from pr) r using (packet_id, line_no)""", "page_rows",
    extra={"pr": "select * from page_rows where line_no%2=1"}))
def _(v):
    odd = v.page_rows.where("line_no % 2 = 1")
    return files.page_fill(odd).select("packet_id", "line_no", "row_status")


# ── field quality ────────────────────────────────────────────────────────────

@query("v1_validate_fields", with_ctes(r"""
select project_id, line_number, concat_ws('|', case when nm='' then 'name_missing' when not contains(nm,' ') then 'name_missing_first_or_last' end,
  case when ad='' then 'address_missing' when not regexp_matches(ad,'^\d') then 'address_missing_street_number' end,
  case when ct='' then 'city_missing' when county<>'' and not exists (select 1 from county_cities c where c.county=q.county and c.city=lower(ct)) then 'city_county_mismatch' end,
  case when z='' then 'zip_missing' when not regexp_matches(z,'^(9[0-5]\d{3}|96[01]\d{2})$') then 'zip_invalid_california' end) flags
from (select e.*, county, trim(b_name) nm, trim(b_address) ad, trim(a_city) ct, trim(b_zip_code) z from extraction_pairs e join projects using (project_id)) q""",
    "extraction_pairs", "projects", "county_cities"))
def _(v):
    rows = v.extraction_pairs.select(*K, F.col("b_name").alias("name"), F.col("b_address").alias("address"), F.col("a_city").alias("city"),
                                     F.col("b_zip_code").alias("zip_code")).join(v.projects.select("project_id", "county"), "project_id")
    return quality.validate_fields(rows, v.county_cities, "county").select(*K, F.array_join("validation_flags", "|").alias("flags"))


@query("v2_f19_row_quality", with_ctes("""
select packet_id, line_no, concat_ws('|', case when raw_name='' then 'missing_name' end, case when raw_address='' then 'missing_street' end, case when raw_city='' then 'missing_city' end,
  case when raw_zip='' then 'missing_zip' end, case when raw_date='' then 'missing_date' end, case when not has_signature then 'no_signature' end,
  case when not valid_zip and raw_zip<>'' then 'invalid_zip_format' end, case when line_no%11 between 1 and 4 then 'low_confidence_name' end,
  case when line_no%7 between 1 and 3 then 'low_confidence_address' end) flags,
  case when line_no%11=0 then 0.0 when line_no%11<5 then 35.0 when line_no%11<8 then 65.0 else 90.0 end name_conf from packet_lines""", "packet_lines"))
def _(v):
    n = F.col("line_no")
    lines = v.packet_lines.withColumns({
        "name_level": tx.confidence_to_level(F.when(n % 11 != 0, (n % 11) / 10.0)),
        "street_level": tx.confidence_to_level(F.when(n % 7 != 0, (n % 7) / 7.5))})
    return lines.select(*PK, F.array_join(quality.row_quality_flags(), "|").alias("flags"), tx.level_to_confidence(F.col("name_level")).alias("name_conf"))


@query("v3_reconcile", with_ctes(r"""
select project_id, line_number, case when ln=lm then a_name when a_name='' then b_name when b_name='' then a_name when a_conf-b_conf>=20 then a_name when b_conf-a_conf>=20 then b_name
    when b_conf>a_conf then b_name else a_name end as name,
  case when a_address=b_address then a_address when a_address='' then b_address when a_conf-b_conf>=20 then a_address when b_conf-a_conf>=20 then b_address
    when regexp_matches(a_address,'^\d') and not regexp_matches(b_address,'^\d') then a_address when b_conf>a_conf then b_address else a_address end address,
  case when lower(replace(a_city,' ',''))=lower(replace(b_city,' ','')) then a_city when a_city='' then b_city when a_conf-b_conf>=20 then a_city else b_city end city,
  case when a_zip_code=b_zip_code then a_zip_code when a_zip_code='' then b_zip_code when a_conf-b_conf>=20 then a_zip_code when b_conf-a_conf>=20 then b_zip_code
    when regexp_matches(a_zip_code,'^(9[0-5]\d{3}|96[01]\d{2})$') and not regexp_matches(b_zip_code,'^(9[0-5]\d{3}|96[01]\d{2})$') then a_zip_code when b_conf>a_conf then b_zip_code else a_zip_code end zip_code,
  concat_ws('|', case when ln=lm and a_name='' or ln<>lm and a_name<>'' and b_name<>'' then 'name' end, case when a_address<>b_address and a_address<>'' then 'address' end,
    case when lower(replace(a_city,' ',''))<>lower(replace(b_city,' ','')) and a_city<>'' then 'city' end, case when a_zip_code<>b_zip_code and a_zip_code<>'' then 'zip' end) disagreements
from (select *, lower(replace(a_name,' ','')) ln, lower(replace(b_name,' ','')) lm from extraction_pairs) q""", "extraction_pairs"))
def _(v):
    return quality.reconcile(v.extraction_pairs).select(*K, "name", "address", "city", "zip_code", F.array_join("disagreements", "|").alias("disagreements"))


@query("u5_fill_blanks", with_ctes("""
select project_id, line_number, case when a_name<>'' then a_name when b_name<>'' and greatest(a_conf,b_conf)>=50 then b_name else '' end raw_name,
  concat_ws(', ', b_address, b_city, b_zip_code) raw_address from extraction_pairs""", "extraction_pairs"))
def _(v):
    rows = v.extraction_pairs.withColumns({"raw_name": F.col("a_name"), "raw_address": F.lit(""), "name": F.col("b_name"), "address": F.col("b_address"),
                                           "city": F.col("b_city"), "zip_code": F.col("b_zip_code")})
    return quality.fill_blanks(rows).select(*K, "raw_name", "raw_address")


@query("v7_low_confidence", with_ctes("select project_id, line_number, case when line_number%9=0 then false else ocr_confidence/100<0.75 end low from lines", "lines"))
def _(v):
    conf = F.when(F.col("line_number") % 9 != 0, F.col("ocr_confidence"))
    return v.lines.select(*K, quality.low_confidence(conf).alias("low"))


@query("p10_p12_reject_reasons", with_ctes("""
select event_id, case when not coalesce(lat between -60 and 90 and lng between -180 and 180, false) then 'bad_coordinates' when worker_id%5=0 then 'bad_method' end reason from pins""", "pins"))
def _(v):
    method = F.when(F.col("worker_id") % 5 == 0, "barter").otherwise("check")
    shifted = v.pins.withColumn("method", method).withColumn("lat", F.when(F.col("lat") < -60, -200.0).otherwise(F.col("lat")))
    checks = {**quality.pin_checks(), **quality.domain_check("method", ["check", "cash"], "bad_method")}
    return shifted.select("event_id", quality.validity_errors(checks).alias("reason"))


@query("s6_admit_uploads", """
select page_id, case when page_id%7=0 then '.exe' when page_id%5=0 then '.pdf' else '.jpg' end suffix,
  case when page_id%7=0 then 'unsupported_type' when length(html)%11=0 then 'empty' when length(html)>3000 then 'too_large' end reject_reason from pages""")
def _(v):
    n = F.col("page_id")
    ext = F.when(n % 7 == 0, ".exe").when(n % 5 == 0, "").otherwise(".JPG")
    src = v.table("pages").select(n, F.concat(F.lit("/in/scan"), n.cast("string"), ext).alias("path"),
                                  F.when(F.length("html") % 11 == 0, 0).otherwise(F.length("html")).alias("length"))
    return files.admit_uploads(src, max_bytes=3000).select("page_id", "suffix", "reject_reason")


@query("s16_failed_documents", "select doc_id, 'failed' status, text error_msg from documents where n_chars%3=0")
def _(v):
    src = v.table("documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.col("text")).alias("error"))
    return tables.split_failures(src)[1]


@query("s3_pasted_roll", with_ctes("""
select roll_pos%50 packet_id, first_name||' '||last_name as name, street_address||' '||city address, zip_code zip from roll""", "roll"))
def _(v):
    line = F.concat_ws("\t", "first_name", "last_name", "street_address", "city", F.concat(F.lit("CA "), F.col("zip_code")))
    texts = v.roll.groupBy((F.col("roll_pos") % 50).alias("packet_id"), F.expr(f"roll_pos div {50 * ROLL_LINES}")).agg(
        F.concat(F.when(F.first("roll_pos") % 2 == 0, "\r\n").otherwise(""), F.array_join(F.collect_list(line), "\r\n")).alias("voter_roll_text"))
    return roll.parse_pasted_roll(texts).select("packet_id", "name", "address", "zip")


@query("s3_pasted_roll_headed", with_ctes("""
select roll_pos%50 packet_id, first_name||' '||last_name as name, street_address address, zip_code zip from roll""", "roll"))
def _(v):
    line = F.concat_ws(",", "zip_code", "first_name", "last_name", "street_address")
    texts = v.roll.groupBy((F.col("roll_pos") % 50).alias("packet_id"), F.expr(f"roll_pos div {50 * ROLL_LINES}")).agg(
        F.concat(F.lit("Zip Code,First Name,LastName,Residence Address\n"), F.array_join(F.collect_list(line), "\n")).alias("voter_roll_text"))
    return roll.parse_pasted_roll(texts).select("packet_id", "name", "address", "zip")


@query("s1_s2_registry_check", with_ctes("select voter_id, last_name, first_name, street_address from roll", "roll"))
def _(v):
    shouted = v.roll.toDF(*[f" {c.upper()} " for c in v.roll.columns])
    return roll.check_columns(shouted).select("voter_id", "last_name", "first_name", "street_address")


@query("f21_rows_from_json", """
select doc_id, case when k<8 then k+1 else k+1 end line_number, 'Signer '||cast(k as varchar) raw_name, cast(k as varchar)||' Oak St, Riverside' raw_address, k%2=0 signature_present
from (select doc_id, unnest(range(0, n_chars%11)) k from documents) q where k%4<>3 or k>=8""".replace("case when k<8 then k+1 else k+1 end", "case when k<8 then k+1 else k-1 end").replace("k%4<>3 or k>=8", "k%4<>3 or k>=8"))
def _(v):
    row = lambda k: F.struct(
        F.when((k % 4 == 3) & (k < 8), "").otherwise(F.concat(F.lit("Signer "), k.cast("string"))).alias("print_name"),
        F.when((k % 4 == 3) & (k < 8), "").otherwise(F.concat(k.cast("string"), F.lit(" Oak St"))).alias("address"),
        F.lit("Riverside").alias("city"), (k + 1).alias("number"), (k % 2 == 0).alias("has_signature"))
    n = F.col("n_chars") % 11
    rows = F.when(n > 0, F.to_json(F.transform(F.sequence(F.lit(0), n - 1), row))).otherwise("[]")
    pages = v.table("documents").select("doc_id", F.lit(1).alias("page"), rows.alias("rows_json"))
    return files.rows_from_json(pages).select("doc_id", "line_number", "raw_name", "raw_address", "signature_present")


@query("x1_json_lists", "select doc_id, case when doc_id%3=0 then 0 when doc_id%3=1 then 2 else 0 end n_days from documents")
def _(v):
    raw = F.when(F.col("doc_id") % 3 == 0, "{oops").when(F.col("doc_id") % 3 == 1, '["mon","tue"]').otherwise("")
    out = files.parse_days(v.table("documents").select("doc_id", raw.alias("preferred_days")))
    return out.select("doc_id", F.size("preferred_days").alias("n_days"))
