"""The same stand-in inputs as DuckDB common table expressions."""

from __future__ import annotations

from .views import FIRST, KINDS, LAST, ROLES, STREETS

CTES: dict[str, tuple[list[str], str]] = {
    "roll": ([], f"""
select c_custkey roll_pos, concat('V',lpad(cast(c_custkey as varchar),6,'0')) voter_id,
  split_part('{FIRST}',',',cast(c_custkey%16 as int)+1) first_name,
  split_part('{LAST}',',',cast(floor(c_custkey/16)%24 as int)+1) last_name,
  concat(cast(100+(c_custkey*13)%900 as varchar),' ',
         split_part('{STREETS}',',',cast((c_custkey*11)%12 as int)+1),' ',
         split_part('{KINDS}',',',cast(c_custkey%4 as int)+1)) street_address,
  replace(lower(n_name),'_',' ') city, 'ca' state,
  cast(90000+(c_custkey*37)%6200 as varchar) zip_code
from customer join nation on c_nationkey=n_nationkey"""),
    "lines": (["roll"], """
select project_id, 1 page, line_number,
  case when l_linenumber=7 and l_quantity<10 then ''
       when l_quantity%7=0 then replace(concat(first_name,' ',last_name),'o','0')
       when l_quantity%11=0 then concat(last_name,', ',first_name)
       else concat(first_name,' ',last_name) end raw_name,
  case when l_linenumber=7 and l_quantity<10 then ''
       else concat(street_address,', ',city,', CA ',zip_code) end raw_address,
  cast(cast(l_shipdate as date) as varchar) raw_date,
  l_returnflag<>'R' signature_present, 50+l_discount*400 ocr_confidence, voter_id true_voter_id
from (select *, cast(row_number() over (partition by project_id order by l_orderkey,l_partkey,l_suppkey,
        l_linenumber,l_quantity,l_extendedprice,l_shipdate,l_discount,l_tax) as int) line_number
      from (select *, cast(floor(l_orderkey/8) as bigint) project_id from lineitem) s) n
cross join (select count(*) n_cust from customer) k
join roll on roll_pos=(project_id*5+l_partkey%400)%n_cust"""),
    "projects": ([], """
select cast(floor(o_orderkey/8) as bigint) project_id, min(o_orderdate) created_at,
  case when floor(o_orderkey/8)%10=0 then '' else min(o_orderpriority) end cause,
  case when floor(o_orderkey/8)%7=0 then '' else min(lower(r_name)) end county
from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
join region on n_regionkey=r_regionkey group by floor(o_orderkey/8)"""),
    "workers": ([], f"""
select s_suppkey worker_id,
  concat(split_part('{FIRST}',',',cast(s_suppkey%16 as int)+1),' ',split_part('{LAST}',',',cast((s_suppkey*5)%24 as int)+1)) full_name,
  split_part('{ROLES}',',',cast(s_suppkey%5 as int)+1) as role,
  cast(18+s_suppkey%12 as double) hourly_wage, s_suppkey%9<>4 is_active,
  case when s_suppkey%6=0 then null else s_nationkey%5 end team_id
from supplier"""),
    "teams": (["workers"], """
select team_id, min(worker_id) manager_id, 'team '||cast(team_id as varchar) team_name
from workers where team_id is not null group by team_id"""),
    "assignments": (["projects"], """
select project_id, project_id%n_supp worker_id, created_at assigned_at
from projects cross join (select count(*) n_supp from supplier) k"""),
    "ev": ([], "select *, user_id%n_supp worker_id from events cross join (select count(*) n_supp from supplier) k"),
    "shifts": (["ev"], """
select event_id shift_id, worker_id, ts clock_in,
  case when event_id%17=0 then null else ts+to_minutes(cast(floor(value) as bigint)%600+30) end clock_out,
  isodow(ts)>=6 is_weekend, event_id%3=0 approved
from ev where event_type in ('view','signup')"""),
    "live_events": (["ev"], """
select worker_id, ts, event_id, cast(floor(value) as bigint) sig_count from ev where event_type='click'"""),
    "pins": (["ev"], """
select event_id, worker_id, ts, case when event_id%10=0 then null else value%180-90 end lat,
  case when event_id%10=0 then null else (value*3)%360-180 end lng from ev where event_type='error'"""),
    "punches": (["ev"], """
select event_id, worker_id, ts, case when event_type='view' then 'in' else 'out' end kind
from ev where event_type in ('view','purchase')"""),
    "pay_periods": ([], """
select cast(date_diff('day', date '2023-12-25', monday) as bigint) pay_period_id,
  cast(monday as varchar) start_date, cast(monday + 6 as varchar) end_date,
  case when monday >= date '2024-01-22' then 'open' else 'closed' end status
from (select distinct cast(date_trunc('week', ts) as date) monday from events) w"""),
    "county_cities": ([], """
select lower(r_name) county, replace(lower(n_name),'_',' ') city from region join nation on n_regionkey=r_regionkey"""),
    "fingerprints": ([], """
select page_id packet_id, substr(md5(url),1,16) fp from pages
union all select page_id+1000000, concat('0',substr(md5(url),2,15)) from pages where page_id%5=0"""),
    "vectors": ([], """
select vec_id, cast(floor(vec_id/20) as bigint) project_id, embedding v from embeddings
union all select vec_id+1000000, cast(floor(vec_id/20) as bigint), list_transform(embedding, lambda x: cast(x+0.001 as float))
from embeddings where vec_id%10=0"""),
    "ocr_words": ([], """
select doc_id, seq, text, seq%12*80 lft, cast(floor(seq/12) as bigint)*30+seq%3 top, 8*length(text) width,
  20 height, 50+seq%50 conf
from (select doc_id, unnest(string_split(text,' ')) text, unnest(range(0,len(string_split(text,' ')))) seq from documents) q
where text<>''"""),
    "packet_lines": (["lines"], """
select project_id packet_id, line_number line_no,
  case when raw_name='' and street='' then 'blank' when line_number%9=0 then 'already_counted'
       when line_number%13=0 then 'changed_needs_review' else 'new_signature' end row_status,
  raw_name, upper(raw_name) norm_name, street raw_address, upper(street) norm_address, raw_city, raw_zip,
  length(raw_zip)=5 valid_zip, raw_date, signature_present has_signature
from (select *, trim(split_part(raw_address,',',1)) street, trim(split_part(raw_address,',',2)) raw_city,
        case when line_number%11=0 then substr(right(raw_address,5),1,4) else right(raw_address,5) end raw_zip
      from lines) q"""),
    "signatures": (["lines"], """
select l.*, case when raw_name='' and raw_address='' then 'rejected' when line_number%17=0 then 'duplicate'
    when ocr_confidence>=70 and signature_present then 'approved' when ocr_confidence>=58 then 'review' else 'rejected' end status,
  case quality when 1 then 'approved' when 0 then 'rejected' end staff_override
from lines l left join labels on doc_id=project_id*32+line_number"""),
    "headers": (["signatures"], """
select project_id, count(*) total_lines, count(*) filter (status='approved') approved, count(*) filter (status='review') review,
  count(*) filter (status='rejected') rejected, count(*) filter (status='duplicate') duplicates,
  count(*) filter (not signature_present and raw_name<>'') fraud_flagged_lines from signatures group by project_id"""),
    "sheets": (["projects", "headers"], "select * from projects join headers using (project_id)"),
    "hand_counts": (["live_events"], """
select 'm-'||cast(event_id as varchar) project_id, worker_id, sig_count%90+1 sig_count, 'hand' notes, ts entered_at from live_events"""),
    "entries": (["hand_counts"], """
select project_id, worker_id, '[manual entry]' pdf_path, sig_count approved, entered_at created_at from hand_counts"""),
    "packet_review": (["packet_lines"], """
select *, case when voter_confidence>=72 then 'valid' when voter_confidence>=45 then 'uncertain' else 'invalid' end voter_status,
  'entry '||cast(voter_confidence as varchar) voter_reason,
  case when row_status='new_signature' and has_signature then 'likely_valid'
       when not has_signature and row_status<>'blank' then 'likely_invalid' else 'needs_review' end ai_verdict,
  case when line_no%8=0 then '["low_confidence"]' when line_no%31=0 then 'not json' when line_no%19=0 then null else '[]' end flags_json,
  case when line_no%10=0 then '["similar_name","invalid_zip"]' else '[]' end fraud_flags,
  case when line_no%10=0 then 50 else 0 end fraud_score,
  case when line_no%14=0 then 'confirmed_fraud' when line_no%15=0 then 'cleared' end review_decision,
  case when line_no%12=0 then 'rejected' end as action
from (select *, cast((packet_id*7+line_no*13)%101 as int) voter_confidence from packet_lines) q"""),
    "rescans": (["lines"], """
select project_id+1000000 project_id, line_number, case when raw_name='' then 'new signer' when line_number%4=0 then replace(raw_name,'a','@') else raw_name end raw_name,
  case when raw_address='' then '1 new st' else raw_address end raw_address from lines"""),
    "rescan_sheets": (["projects"], "select * replace (project_id+1000000 as project_id) from projects"),
    "norm": (["lines"], """
select *, concat_ws(' ', nullif(last_name,''), nullif(first_name,''), nullif(split_part(street,' ',1),''), nullif(split_part(street,' ',2),'')) search_key
from (select *, case when contains(raw_name,',') then trim(split_part(raw_name,',',2)) when contains(raw_name,' ') then split_part(raw_name,' ',1) else '' end first_name,
    case when contains(raw_name,',') then trim(split_part(raw_name,',',1)) when contains(raw_name,' ') then split_part(raw_name,' ',2) else raw_name end last_name,
    split_part(raw_address,',',1) street, trim(split_part(raw_address,',',2)) city, case when raw_address='' then '' else 'ca' end state,
    right(raw_address,5) zip_code, replace(raw_date,'-',' ') as date from lines) q"""),
    "extraction_pairs": (["lines", "roll"], """
select project_id, line_number, raw_name a_name, split_part(raw_address,',',1) a_address,
  case when line_number%5=0 then '' else trim(split_part(raw_address,',',2)) end a_city, right(raw_address,5) a_zip_code,
  case when line_number%6=0 then '' else upper(left(first_name,1))||substr(first_name,2)||' '||upper(left(last_name,1))||substr(last_name,2) end b_name,
  case when line_number%4=0 then split_part(street_address,' ',2) else street_address end b_address,
  list_reduce(list_transform(string_split(r.city,' '), lambda w: upper(left(w,1))||substr(w,2)), lambda x,y: x||' '||y) b_city,
  case when line_number%3=0 then substr(r.zip_code,1,4) else r.zip_code end b_zip_code,
  cast(trunc(ocr_confidence) as int) a_conf, cast(50+(line_number*7)%45 as int) b_conf
from lines join roll r on voter_id=true_voter_id"""),
    "ocr_pages": (["ocr_words"], "select doc_id, 1000 page_width, max(top+height) page_height from ocr_words group by doc_id"),
    "page_rows": (["fingerprints", "lines"], """
select packet_id, line_number line_no, case when raw_name='' then 'blank' else 'new_signature' end row_status,
  upper(case when packet_id>=1000000 and line_number%3=0 then 'zz'||raw_name else raw_name end||'|'||split_part(raw_address,',',1))
    ||'#'||substr(md5(raw_address),1,9) row_fingerprint
from fingerprints join lines on project_id=packet_id%1000000"""),
}


def with_ctes(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``query`` behind the CTEs it names, dependencies first, then ``extra`` ones."""
    order: list[str] = []

    def add(n):
        for dep in CTES[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as materialized ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} as materialized ({sql.strip()})" for n, sql in (extra or {}).items()]
    return f"with {', '.join(parts)} {query.strip()}" if parts else query.strip()


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x},' '), lambda w: w<>'')),' ')"


def may_reach(a: str, b: str, t: int) -> str:
    return f"levenshtein({a},{b}) <= ({100 - t}*(length({a})+length({b})))//100"


def ratio_ctes(name: str, pairs: str) -> dict[str, str]:
    """CTEs ending in ``name``(a, b, ratio) for the distinct (a, b) of CTE ``pairs``.

    Bit-parallel longest common subsequence on 64-bit integers: texts up to 62 characters.
    """
    return {
        f"{name}_c": f"""select a, ch, sum(cast(1 as bigint) << cast(i as int)) m from (
            select a, unnest(string_split(a,'')) ch, unnest(range(length(a))) i from (select distinct a from {pairs} where a<>'')) q group by a, ch""",
        f"{name}_m": f"select a, map_from_entries(list((ch, cast(m as bigint)))) mp from {name}_c group by a",
        name: f"""select a, b, case when length(a)+length(b)=0 then 0.0
            else (1.0 - (length(a)+length(b)-2*lcs)/cast(length(a)+length(b) as double))*100.0 end ratio from (
            select p.a, p.b, case when p.a='' or p.b='' then 0 else length(p.a) - bit_count(list_reduce(
              list_prepend((cast(1 as bigint) << length(p.a))-1, list_transform(string_split(p.b,''), lambda c: coalesce(mp[c], cast(0 as bigint)))),
              lambda v, k: ((v + (v & k)) | (v - (v & k))) & ((cast(1 as bigint) << length(p.a))-1))) end lcs
            from (select distinct a, b from {pairs}) p left join {name}_m m on m.a=p.a) z""",
    }


def round_py(x: str, digits: int = 0) -> str:
    """Half-to-even on the exact binary value, as the Spark expression does it."""
    if digits == 0:
        return f"round_even({x},0)"
    s = f"{10**digits}.0::double"
    v, p = f"({x})::double", f"(({x})::double*{s})"
    hi = f"({v}*134217729.0::double-({v}*134217729.0::double-{v}))"
    err = f"(({hi}*{s}-{p})+({v}-{hi})*{s})"
    return (f"(case when {p}-floor({p})=0.5 and {err}>0 then ceil({p}) when {p}-floor({p})=0.5 and {err}<0 then floor({p}) "
            f"else round_even({p},0) end/{s})")


HOURS = "(epoch_us(clock_out)-epoch_us(clock_in))"


def sequence_ctes(name: str, pairs: str) -> dict[str, str]:
    """CTEs ending in ``name``(a, b, ratio): the matching-blocks ratio of the distinct (a, b) of CTE ``pairs``.

    Texts of under 200 characters. A cell is a pair of equal characters with the length of the equal run that ends
    there; a stretch takes its longest run, cut at its edges, and opens one stretch before and one behind it.
    """
    return {
        f"{name}_p": f"select a, b, row_number() over () p from (select distinct a, b from {pairs} where a<>'' and b<>'') q",
        f"{name}_l": f"select p, unnest(string_split(a,'')) ch, unnest(range(length(a))) i from {name}_p",
        f"{name}_r": f"select p, unnest(string_split(b,'')) ch, unnest(range(length(b))) j from {name}_p",
        f"{name}_c": f"""select p, i, j, row_number() over (partition by p, i-j, island order by i) run from (
            select l.p, i, j, i - row_number() over (partition by l.p, i-j order by i) island
            from {name}_l l join {name}_r r on l.p=r.p and l.ch=r.ch) q""",
        f"{name}_s": f"""select * from (with recursive open(p, alo, ahi, blo, bhi, gained) as (
            select p, 0::bigint, length(a)::bigint, 0::bigint, length(b)::bigint, 0::bigint from {name}_p
            union all
            select p, unnest([alo, i+1]), unnest([i+1-k, ahi]), unnest([blo, j+1]), unnest([j+1-k, bhi]), unnest([k, 0])
            from (select p, alo, ahi, blo, bhi, -best.k k, best.i i, best.j j
                  from (select o.p, alo, ahi, blo, bhi, min({{'k': -least(run, i-alo+1, j-blo+1), 'i': i, 'j': j}}) best
                        from open o join {name}_c c on c.p=o.p and i>=alo and i<ahi and j>=blo and j<bhi group by o.p, alo, ahi, blo, bhi) v) w)
            select p, sum(gained) m from open group by p)""",
        name: f"""select a, b, case when length(a)+length(b)=0 then 1.0::double
            else 2.0::double*coalesce(m,0)/(length(a)+length(b)) end ratio
            from (select distinct a, b from {pairs}) d left join {name}_p using (a, b) left join {name}_s using (p)""",
    }


def expanded(x: str) -> str:
    """Upper case, punctuation to blanks, street types spelled out."""
    from ..functions.text import STREET_LONG
    out = f"regexp_replace(trim(upper({x})), '[^\\w\\s]', ' ', 'g')"
    for short, long in STREET_LONG.items():
        if short != long:
            out = f"regexp_replace({out}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def packet_ctes(weights: tuple[float, float, float], k: int) -> dict[str, str]:
    """CTEs ending in ``found``: the k best pasted entries of every distinct (name, address, zip) of named packet rows.

    Names are scored for all distinct pairs. A Levenshtein bound on addresses gives k entries whose exact score is a
    floor; addresses are scored where the bound reaches it.
    """
    wn, wa, wz = (f"{w}::double" for w in weights)
    zip5 = "substr(trim(raw_zip),1,5)" if weights[2] else "''"
    whole = lambda place: f"(ns*{wn}+{place}*{wa})+(case when az<>'' and az=pz then 1.0::double else 0.0::double end)*{wz}"
    return {
        "asked_rows": f"""select packet_id, line_no, {expanded('raw_name')} an, {expanded('raw_address')} aa, {zip5} az
            from packet_lines where row_status<>'blank' and raw_name<>''""",
        "asked": "select *, row_number() over () q from (select distinct an, aa, az from asked_rows) d",
        "pool": f"""select roll_pos pos, first_name||' '||last_name pname, street_address||' '||city paddress, {expanded("first_name||' '||last_name")} pn,
            {expanded("street_address||' '||city")} pa, zip_code pz from roll""",
        "name_pairs": "select a, b from (select distinct an a from asked) x, (select distinct pn b from pool) y",
        **sequence_ctes("nr", "name_pairs"),
        "bounds": """select a, b, case when a='' or b='' then 0.0::double else 1.0::double-levenshtein(a,b)/(length(a)+length(b))::double end ub
            from (select distinct aa a from asked) x, (select distinct pa b from pool) y""",
        "capped": f"""select q, pos, aa, pa, az, pz, ns, {whole('ub')} cap from (select q, pos, aa, pa, az, pz, nr.ratio ns, ub
            from asked join nr on nr.a=an join pool on pn=nr.b join bounds on bounds.a=aa and bounds.b=pa) c""",
        "probes": f"select * from capped qualify row_number() over (partition by q order by cap desc, pos)<={k}",
        "probe_pairs": "select distinct aa a, pa b from probes",
        **sequence_ctes("pr", "probe_pairs"),
        "floors": f"select q, min({whole('case when aa=' + chr(39) * 2 + ' then 0.0::double else ratio end')}) low from probes join pr on pr.a=aa and pr.b=pa group by q",
        "reaching": "select c.* from capped c join floors using (q) where cap>=low-1e-9",
        "place_pairs": "select distinct aa a, pa b from reaching",
        **sequence_ctes("ar", "place_pairs"),
        "found": f"""select q, pos, score, row_number() over (partition by q order by score desc, pos) rn
            from (select q, pos, {whole('case when aa=' + chr(39) * 2 + ' then 0.0::double else ratio end')} score
                  from reaching join ar on ar.a=aa and ar.b=pa) s qualify rn<={k}""",
    }
