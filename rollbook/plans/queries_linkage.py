"""Scalars, similarity, linkage, deduplication, re-uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions import values as vl
from ..operators import linkage, resheet, similar, workforce
from ..session import cut
from .oracle_views import expanded, may_reach, packet_ctes, ratio_ctes, round_py, sequence_ctes, sorted_tokens, with_ctes
from .registry import query
from .views import Views


def pasted(v: Views):
    """The registry as pasted entries: pos, name, address with city, zip."""
    return v.roll.select(F.col("roll_pos").alias("pos"), F.concat_ws(" ", "first_name", "last_name").alias("name"),
                         F.concat_ws(" ", "street_address", "city").alias("address"), F.col("zip_code").alias("zip"))


@query("f1_clean", r"""
select doc_id, trim(regexp_replace(lower(strip_accents(text)),'[^a-z0-9]+',' ','g')) cleaned from documents""")
def _(v):
    return v.table("documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("f2_f5_normalize_lines", with_ctes("""
select project_id, line_number, first_name, last_name, street, city, state, zip_code, date, search_key from norm""", "norm"))
def _(v):
    return linkage.normalize_lines(v.lines).select(
        "project_id", "line_number", "first_name", "last_name", "street", "city", "state", "zip_code", "date", "search_key")


@query("f6_roll_search_key", with_ctes("select voter_id, last_name||' '||first_name||' '||street_address search_key from roll", "roll"))
def _(v):
    return v.roll.select("voter_id", tx.roll_search_key(F.col("last_name"), F.col("first_name"), F.col("street_address")).alias("search_key"))


@query("f7_exact_key", with_ctes("""
select project_id, line_number, case when trim(last_name||'|'||first_name,'|')='' or street='' then ''
  else trim(last_name||'|'||first_name,'|')||'|'||street||'|'||city||'|'||zip_code end exact_key from norm""", "norm"))
def _(v):
    n = linkage.normalize_lines(v.lines)
    return n.select("project_id", "line_number", tx.exact_key(*[F.col(c) for c in ("last_name", "first_name", "street", "city", "zip_code")]).alias("exact_key"))


@query("f8_house_street_date", with_ctes(r"""
select project_id, line_number, try_cast(regexp_extract(raw_address,'^\s*(\d+)',1) as bigint) house_number,
  lower(trim(regexp_replace(raw_address,'^\s*\d+\s*',''))) street, replace(raw_date,'-','') date_key from lines""", "lines"))
def _(v):
    return v.lines.select("project_id", "line_number", tx.house_number(F.col("raw_address")).cast("bigint").alias("house_number"),
                          tx.street_without_number(F.col("raw_address")).alias("street"), tx.squeeze_date(F.col("raw_date")).alias("date_key"))


@query("f9_f10_expand_split_address", with_ctes(r"""
select project_id, line_number, upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(raw_address,',',1),
    ' st$',' street'),' ave$',' avenue'),' rd$',' road'),' blvd$',' boulevard')) expanded,
  split_part(raw_address,',',1) street, case when raw_address='' then '' else trim(split_part(raw_address,',',2)) end city, right(raw_address,5) part_zip
from lines""", "lines").replace("part_zip", "zip"))
def _(v):
    lines = tx.with_split_address(v.lines, F.replace("raw_address", F.lit(", CA "), F.lit(", ")), "street", "city", "zip")
    return lines.select("project_id", "line_number", tx.expand_streets(F.split_part("raw_address", F.lit(","), F.lit(1))).alias("expanded"),
                          "street", "city", "zip")


@query("f11_token_sort_ratio", with_ctes(
    "select project_id, line_number, ratio from named join rt on a=ta and b=tb", "norm", "roll",
    extra={"named": f"""select project_id, line_number, {sorted_tokens("lower(n.raw_name)")} ta, {sorted_tokens("r.first_name||' '||r.last_name")} tb
                     from norm n join roll r on voter_id=true_voter_id""",
           "pr": "select distinct ta a, tb b from named", **ratio_ctes("rt", "pr")}))
def _(v):
    r = v.roll.select(F.col("voter_id").alias("true_voter_id"), F.concat_ws(" ", "first_name", "last_name").alias("who"))
    return v.lines.join(r, "true_voter_id").select(
        "project_id", "line_number", sim.token_sort_ratio(F.lower("raw_name"), F.col("who")).alias("ratio"))


@query("f12_sequence_ratio", with_ctes("""
select project_id, line_number, ratio from said join sr on sr.a=said.a and sr.b=said.b""", "lines", "roll", extra={
    "said": f"""select project_id, line_number, {expanded('raw_name')} a, {expanded("first_name||' '||last_name")} b
        from lines join roll on voter_id=true_voter_id""", **sequence_ctes("sr", "said")}))
def _(v):
    r = v.roll.select(F.col("voter_id").alias("true_voter_id"), F.concat_ws(" ", "first_name", "last_name").alias("who"))
    return v.lines.join(r, "true_voter_id").select(
        "project_id", "line_number", sim.sequence_ratio(tx.expand_streets(F.col("raw_name")), tx.expand_streets(F.col("who"))).alias("ratio"))


@query("f13_field_normalizers", with_ctes(r"""
select project_id, line_number, regexp_replace(upper(raw_name),'[^A-Z \-]','','g') name,
  case when raw_address='' then '' else split_part(street,' ',1)||' '||upper(left(split_part(street,' ',2),1))||substr(split_part(street,' ',2),2)||' '||upper(split_part(street,' ',3)) end address,
  coalesce(trim(list_reduce(list_transform(string_split(regexp_replace(city,'[^A-Za-z -]','','g'),' '), lambda w: upper(left(w,1))||substr(w,2)), lambda x,y: x||' '||y)),'') city,
  zip_code zip, raw_address<>'' zip_ok from norm""", "norm"))
def _(v):
    n = linkage.normalize_lines(v.lines)
    z = tx.field_zip(F.col("raw_address"))
    return n.select("project_id", "line_number", tx.field_name(F.col("raw_name")).alias("name"), tx.field_address(F.col("street")).alias("address"),
                    tx.field_city(F.col("city")).alias("city"), z["zip"].alias("zip"), z["valid"].alias("zip_ok"))


@query("f14_f15_noise_and_labels", with_ctes(rf"""
select doc_id, seq, length(text)>60 or regexp_matches(text,'(?i)\b({'|'.join(tx.HEADER_WORDS)})\b') noise,
  trim(text,':.,_- ')='' or regexp_matches(text,'^[:\-_\.,;()/|]{{1,3}}$') or regexp_matches(trim(text,':.,_- '),'(?i)^({'|'.join(tx.PRINTED_LABELS)})$') printed
from ocr_words""", "ocr_words"))
def _(v):
    return v.ocr_words.select("doc_id", "seq", tx.is_header_noise(F.col("text")).alias("noise"), tx.is_printed_label(F.col("text")).alias("printed"))


@query("f17_hamming", with_ctes("""
select a.packet_id, b.packet_id other_id, cast(bit_count(xor(('0x'||substr(a.fp,1,8))::bigint,('0x'||substr(b.fp,1,8))::bigint))
  +bit_count(xor(('0x'||substr(a.fp,9,8))::bigint,('0x'||substr(b.fp,9,8))::bigint)) as int) distance
from fingerprints a join fingerprints b on b.packet_id=a.packet_id+1000000""", "fingerprints"))
def _(v):
    f = v.fingerprints
    other = f.select((F.col("packet_id") - 1000000).alias("packet_id"), F.col("packet_id").alias("other_id"), F.col("fp").alias("fp2"))
    return f.join(other, "packet_id").select("packet_id", "other_id", sim.hamming_hex(F.col("fp"), F.col("fp2")).alias("distance"))


@query("f18_row_fingerprint_similarity", with_ctes("""
select packet_id, line_no, ratio/100*0.70+(1.0-hd/36.0::double)*0.30 score from pairs join rt on a=ta and b=tb""", "page_rows",
    extra={"pairs": f"""select x.packet_id, x.line_no, {sorted_tokens("split_part(x.row_fingerprint,'#',1)")} ta, {sorted_tokens("split_part(y.row_fingerprint,'#',1)")} tb,
             bit_count(xor(('0x'||split_part(x.row_fingerprint,'#',2))::bigint,('0x'||split_part(y.row_fingerprint,'#',2))::bigint)) hd
             from page_rows x join page_rows y on y.packet_id=x.packet_id+1000000 and y.line_no=x.line_no""",
           "pr": "select distinct ta a, tb b from pairs", **ratio_ctes("rt", "pr")}))
def _(v):
    r = v.page_rows
    other = r.select((F.col("packet_id") - 1000000).alias("packet_id"), "line_no", F.col("row_fingerprint").alias("fp2"))
    return r.join(other, ["packet_id", "line_no"]).select("packet_id", "line_no", sim.fingerprint_similarity(F.col("row_fingerprint"), F.col("fp2")).alias("score"))


@query("m3_cosine", with_ctes("""
select a.vec_id, round(list_dot_product(a.v::double[],b.v::double[])/(sqrt(list_dot_product(a.v::double[],a.v::double[]))*sqrt(list_dot_product(b.v::double[],b.v::double[]))+1e-9),6) cosine
from vectors a join vectors b on b.vec_id=a.vec_id+1000000""", "vectors"))
def _(v):
    x = v.vectors
    y = x.select((F.col("vec_id") - 1000000).alias("vec_id"), F.col("v").alias("v2"))
    return x.join(y, "vec_id").select("vec_id", F.round(sim.cosine(F.col("v"), F.col("v2")), 6).alias("cosine"))


@query("m8_round_half_even", with_ctes(f"""
select event_id, {round_py('value',1)} r1, {round_py('value/7',2)} r2, {round_py('value')} r0 from events"""))
def _(v):
    x = F.col("value")
    return v.table("events").select("event_id", vl.round_py(x, 1).alias("r1"), vl.round_py(x / 7, 2).alias("r2"), vl.round_py(x).alias("r0"))


# ── linkage ──────────────────────────────────────────────────────────────────

TOP5 = {
    "qk": f"select distinct {sorted_tokens('search_key')} qkey from norm where search_key<>''",
    "rk": f"select *, {sorted_tokens(chr(39) + chr(39) + '||last_name||' + chr(39) + ' ' + chr(39) + '||first_name||' + chr(39) + ' ' + chr(39) + '||street_address')} pkey from roll",
    "rd": "select pkey, min(roll_pos) pos from rk group by pkey",
    # Levenshtein <= indel <= 2 * Levenshtein bounds the ratio from both sides.
    "lv": """select qkey, pkey, pos, levenshtein(qkey,pkey)/cast(length(qkey)+length(pkey) as double) d from qk, rd""",
    "fl": "select qkey, list_min(max(1-2*d, 5)) floor_at from lv group by qkey",
    "cd": "select lv.qkey, lv.pkey from lv join fl using (qkey) where 1-d >= floor_at-1e-9",
    "pr": "select qkey a, pkey b from cd", **ratio_ctes("rt", "pr"),
    "top5": """select qkey, rk.*, score, rn from (select a qkey, rk.roll_pos p, ratio score,
        row_number() over (partition by a order by ratio desc, rk.roll_pos) rn from rt join rk on rk.pkey=rt.b) t join rk on rk.roll_pos=p where rn<=5""",
}


@query("j1_stage1_top5", with_ctes("select qkey, voter_id, rn::int as rank, score from top5", "norm", "roll", extra=TOP5))
def _(v):
    n = linkage.normalize_lines(v.lines).select(sim.sort_tokens(F.col("search_key")).alias("qkey"))
    r = v.roll.select("voter_id", F.col("roll_pos").alias("pos"), sim.sort_tokens(
        tx.roll_search_key(F.col("last_name"), F.col("first_name"), F.col("street_address"))).alias("pkey"))
    r = linkage.keep_best(r, "pkey", ["pos"], 5).drop("rank")
    top = linkage.top_keys(n, r.groupBy("pkey").agg(F.min("pos").alias("key_pos")), 5)
    return linkage.keep_best(top.join(r, "pkey"), "qkey", [F.desc("score"), "pos"], 5).select("qkey", "voter_id", "rank", "score")


MATCH = {
    **TOP5,
    "asked": f"""select distinct {sorted_tokens('search_key')} qkey, trim(last_name||' '||first_name) nm, street ad, zip_code z from norm where search_key<>''""",
    "cand": f"""select a.*, t.voter_id, t.first_name, t.last_name, t.street_address, t.zip_code vz, rn,
        {sorted_tokens('nm')} na, {sorted_tokens("t.last_name||' '||t.first_name")} nb, {sorted_tokens('ad')} aa, {sorted_tokens('t.street_address')} ab
        from asked a join top5 t using (qkey)""",
    "pr2": "select na a, nb b from cand union select aa, ab from cand", **ratio_ctes("rs", "pr2"),
    "scored": """select c.*, x.ratio ns, case when z<>'' and z=vz then least(100.0,y.ratio+5) else y.ratio end ads
        from cand c join rs x on x.a=na and x.b=nb join rs y on y.a=aa and y.b=ab""",
    "best": """select *, 0.60*ns+0.40*ads conf from scored qualify row_number() over (partition by qkey,nm,ad,z order by 0.60*ns+0.40*ads desc, rn)=1""",
    "matched": f"""select n.*, b.voter_id, {round_py('conf',1)} match_confidence, {round_py('ns',1)} name_score, {round_py('ads',1)} address_score
        from norm n left join best b on b.qkey={sorted_tokens('n.search_key')} and b.nm=trim(n.last_name||' '||n.first_name) and b.ad=n.street and b.z=n.zip_code""",
}


@query("j1_voter_match", with_ctes("""
select project_id, line_number, voter_id, match_confidence, name_score, address_score from matched""", "norm", "roll", extra=MATCH))
def _(v):
    n = cut(linkage.normalize_lines(v.lines))
    return linkage.match_lines(n, v.roll).select("project_id", "line_number", "voter_id", "match_confidence", "name_score", "address_score")


@query("v5_status_policy", with_ctes("""
select project_id, line_number, case when duplicate_of is not null then 'duplicate'
  when conf>=85 then case when signature_present then 'approved' else 'review' end when conf>=70 then 'review' else 'rejected' end status
from (select *, case when line_number%17=0 then 1 end duplicate_of, ocr_confidence+line_number%20 conf from lines) q""", "lines"))
def _(v):
    dup = F.when(F.col("line_number") % 17 == 0, 1)
    return v.lines.select("project_id", "line_number", linkage.classify(
        F.col("ocr_confidence") + F.col("line_number") % 20, F.col("signature_present"), dup).alias("status"))


DUPES = {
    "keyed": f"""select project_id, line_number, {sorted_tokens('search_key')} t, case when trim(last_name||'|'||first_name,'|')='' or street='' then ''
        else last_name||'|'||first_name||'|'||street||'|'||city||'|'||zip_code end x from norm""",
    "inpairs": f"""select i.project_id, i.line_number li, j.line_number lj, i.t a, j.t b, i.x<>'' and i.x=j.x same from keyed i join keyed j
        on i.project_id=j.project_id and i.line_number<j.line_number where (i.x<>'' and i.x=j.x) or (i.t<>'' and j.t<>'' and {may_reach('i.t','j.t',92)})""",
    "dp": "select a, b from inpairs where a<>'' and b<>''", **ratio_ctes("dr", "dp"),
    "nb": """select project_id, lj line_number, list(li) filter (same) ex, list(li) filter (coalesce(ratio,0)>=92) fz
        from inpairs left join dr using (a,b) group by project_id, lj""",
    "full_nb": "select k.project_id, k.line_number, coalesce(ex,[]) ex, coalesce(fz,[]) fz from keyed k left join nb using (project_id,line_number)",
    "walk_": """select * from (with recursive walk(project_id, n, leaders, dup) as (
        select project_id, 0, []::int[], null::int from (select distinct project_id from full_nb) q
        union all select w.project_id, w.n+1, case when d is null then list_append(leaders, w.n+1) else leaders end, d
        from (select w.*, coalesce(list_min(list_intersect(leaders, ex)), list_min(list_intersect(leaders, fz))) d
              from walk w join full_nb f on f.project_id=w.project_id and f.line_number=w.n+1) w)
        select project_id, n line_number, dup duplicate_of_line from walk where n>0)""",
}


@query("w8_leader_dedup", with_ctes("select project_id, line_number, duplicate_of_line from walk_", "norm", extra=DUPES))
def _(v):
    n = cut(linkage.normalize_lines(v.lines).select("project_id", "line_number", "first_name", "last_name", "street", "city", "zip_code", "search_key"))
    return similar.find_duplicates(n).select("project_id", "line_number", "duplicate_of_line")


def verified(v: Views, signed: bool = True):
    """Normalized, matched, deduplicated and classified lines."""
    n = cut(linkage.normalize_lines(v.lines))
    m = linkage.match_lines(n, v.roll)
    d = similar.find_duplicates(n).select("project_id", "line_number", "duplicate_of_line")
    out = m.join(d, ["project_id", "line_number"])
    return out.withColumn("status", linkage.classify(
        F.coalesce("match_confidence", F.lit(0.0)), F.col("signature_present"), F.col("duplicate_of_line")))


VERIFY = {**MATCH, **DUPES, "verified": """select m.*, duplicate_of_line, case when duplicate_of_line is not null then 'duplicate'
    when coalesce(match_confidence,0)>=85 then case when signature_present then 'approved' else 'review' end
    when coalesce(match_confidence,0)>=70 then 'review' else 'rejected' end status
    from matched m join walk_ using (project_id, line_number)"""}


@query("a1_verify_sheets", with_ctes(f"""
select *, {round_py('approved/cast(greatest(total,1) as double)*100',1)} auto_rate_pct from (select project_id, count(*) total,
  count(*) filter (status='approved') approved, count(*) filter (status='review') review,
  count(*) filter (status='rejected') rejected, count(*) filter (status='duplicate') duplicates from verified group by project_id) q""",
    "norm", "roll", extra=VERIFY))
def _(v):
    return workforce.sheet_summary(verified(v))


@query("j2_packet_match", with_ctes("""
select packet_id, line_no, case when conf>=72 then 'valid' when conf>=45 then 'uncertain' else 'invalid' end voter_status, conf voter_confidence,
  case when conf>=72 then 'Matched: '||shown when conf>=45 then 'Partial match ('||conf||'%): '||shown else 'No voter roll match found' end voter_reason
from (select packet_id, line_no, coalesce(cast(trunc(case when score>0 then score end*100) as int),0) conf,
        coalesce(case when score>0 then pname||' — '||paddress end,'none') shown
      from asked_rows join asked using (an, aa, az) left join found using (q) left join pool using (pos)) w""",
    "packet_lines", "roll", extra=packet_ctes(linkage.PACKET_WEIGHTS, 1)))
def _(v):
    return linkage.packet_match(v.packet_lines, pasted(v)).select("packet_id", "line_no", "voter_status", "voter_confidence", "voter_reason")


@query("j3_packet_candidates", with_ctes("""
select packet_id, line_no, cast(rn as int) as rank, pos, score from asked_rows join asked using (an, aa, az) join found using (q)""",
    "packet_lines", "roll", extra=packet_ctes(linkage.CANDIDATE_WEIGHTS, 5)))
def _(v):
    return linkage.packet_candidates(v.packet_lines, pasted(v)).select("packet_id", "line_no", "rank", "pos", "score")


# ── re-uploads ───────────────────────────────────────────────────────────────

SHEETS = {
    **{f"k{n}": f"""select project_id, line_number, {sorted_tokens('lower(trim(raw_name))')} nm, {sorted_tokens('lower(trim(raw_address))')} ad
        from {t} where raw_name<>'' or raw_address<>''""" for n, t in (("n", "rescans"), ("o", "lines"))},
    "sp": """select a.project_id new_id, b.project_id old_id, b.created_at from rescan_sheets a join projects b on
        (a.cause='' or b.cause='' or lower(a.cause)=lower(b.cause)) and (a.county='' or b.county='' or lower(a.county)=lower(b.county))""",
    "np": "select a, b from (select distinct nm a from ko), (select distinct nm b from kn) where a<>'' and b<>'' and " + may_reach("a", "b", 75),
    "apx": "select a, b from (select distinct ad a from ko), (select distinct ad b from kn) where a<>'' and b<>'' and " + may_reach("a", "b", 75),
    **ratio_ctes("nr", "np"), **ratio_ctes("ar", "apx"),
    "hit_names": "select a, b from nr where ratio>=75", "hit_places": "select a, b from ar where ratio>=75",
    "lp": """select new_id, old_id, created_at, count(*) matches from sp join kn n on n.project_id=new_id join ko o on o.project_id=old_id and o.line_number=n.line_number
        left join hit_names h on h.a=o.nm and h.b=n.nm left join hit_places g on g.a=o.ad and g.b=n.ad
        where h.a is not null or g.a is not null group by all""",
    "found": """select new_id project_id, old_id original_id, matches, filled, matches/cast(filled as double) score
        from lp join (select project_id old_id, count(*) filled from ko group by 1) f using (old_id)
        where matches/cast(filled as double)>=0.5
        qualify row_number() over (partition by new_id order by matches/cast(filled as double) desc, created_at, old_id)=1""",
}


@query("j4_same_sheet", with_ctes("select project_id, original_id, matches, filled, score from found", "rescans", "rescan_sheets", extra=SHEETS))
def _(v):
    return resheet.find_same_sheet(v.rescan_sheets, cut(v.rescans), v.projects, cut(v.lines.select(
        "project_id", "line_number", "raw_name", "raw_address")))


@query("j5_continuation_split", with_ctes("""
select f.project_id, f.original_id, r.line_number, not coalesce(o.raw_name<>'' or o.raw_address<>'', false) is_new
from found f join rescans r using (project_id) left join lines o on o.project_id=f.original_id and o.line_number=r.line_number
where r.raw_name<>'' or r.raw_address<>''""", "rescans", "rescan_sheets", extra=SHEETS))
def _(v):
    lines = cut(v.lines.select("project_id", "line_number", "raw_name", "raw_address"))
    rescans = cut(v.rescans)
    found = resheet.find_same_sheet(v.rescan_sheets, rescans, v.projects, lines)
    return resheet.split_continuation(found, rescans, lines).select("project_id", "original_id", "line_number", "is_new")


BITS = """bit_count(xor(('0x'||substr(a.fp,1,8))::bigint,('0x'||substr(b.fp,1,8))::bigint))+bit_count(xor(('0x'||substr(a.fp,9,8))::bigint,('0x'||substr(b.fp,9,8))::bigint))"""


@query("j6_similar_pages", with_ctes(f"""
select distinct a.fp new_fp, b.fp old_fp from fingerprints a, fingerprints b where {BITS}<=10""", "fingerprints"))
def _(v):
    return resheet.similar_pages(v.fingerprints, v.fingerprints)


EARLIER = {"er": f"""select distinct a.packet_id, r.row_fingerprint old_row from fingerprints a join fingerprints b on a.packet_id<>b.packet_id and {BITS}<=10
    join page_rows r on r.packet_id=b.packet_id where r.row_status in ('new_signature','already_counted')""",
    "pairs": f"""select e.packet_id, p.line_no, {sorted_tokens("split_part(p.row_fingerprint,'#',1)")} ta, {sorted_tokens("split_part(old_row,'#',1)")} tb,
      bit_count(xor(('0x'||split_part(p.row_fingerprint,'#',2))::bigint,('0x'||split_part(old_row,'#',2))::bigint)) hd
      from page_rows p join er e using (packet_id) where p.row_status<>'blank'""",
    "pr": "select distinct ta a, tb b from pairs", **ratio_ctes("rt", "pr"),
    "bs": "select packet_id, line_no, max(ratio/100*0.70+(1.0-hd/36.0::double)*0.30) s from pairs join rt on a=ta and b=tb group by 1,2"}


@query("j7_row_versioning", with_ctes("""
select packet_id, line_no, case when row_status='blank' then 0.0 else coalesce(s,0.0) end best_score,
  case when row_status='blank' then 'blank' when coalesce(s,0)>=0.75 then 'already_counted' when coalesce(s,0)>=0.45 then 'changed_needs_review' else row_status end row_status
from page_rows left join bs using (packet_id, line_no)""", "page_rows", "fingerprints", extra=EARLIER))
def _(v):
    pages = v.fingerprints.withColumn("status", F.lit("done"))
    rows = cut(v.page_rows)
    return resheet.version_rows(rows, resheet.earlier_rows(pages, rows)).select("packet_id", "line_no", "best_score", "row_status")


@query("p11_comparable_sheets", with_ctes("select new_id, old_id from sp", "rescan_sheets", extra={"sp": SHEETS["sp"]}))
def _(v):
    return resheet.comparable_sheets(v.rescan_sheets, v.projects)
