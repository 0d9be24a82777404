"""Word boxes to rows, over the words of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..functions import text as tx
from .oracle_views import round_py, with_ctes
from .registry import query
from .views import Views


@query("w10_cluster_rows", with_ctes("""
select w.doc_id, w.seq, r.row from ocr_words w join (
  select doc_id, top, sum(case when s is null then 0 else 1 end) over (partition by doc_id order by top) as row
  from (select distinct doc_id, top from ocr_words) t left join (select doc_id d, s from starts) x on x.d=t.doc_id and x.s=t.top) r using (doc_id, top)""", "ocr_words",
    extra={"tops": "select distinct doc_id, top from ocr_words",
           "starts": """select * from (with recursive r as (select doc_id, min(top) s from tops group by 1
             union all select r.doc_id, min(t.top) from r join tops t on t.doc_id=r.doc_id and t.top>r.s+20 group by r.doc_id) select doc_id, s from r)"""}))
def _(v):
    return layout.cluster_rows(v.ocr_words).select("doc_id", "seq", "row")


@query("a17_row_confidence", with_ctes(f"""
select doc_id, dense_rank() over (partition by doc_id order by g) as row, n n_words, {round_py('a',1)} ocr_confidence
from (select doc_id, seq//12 g, count(*) n, avg(conf) a from ocr_words group by 1,2) q""", "ocr_words"))
def _(v):
    return layout.row_confidence(layout.cluster_rows(v.ocr_words))


@query("w11_cluster_values", with_ctes("""
select doc_id, cluster, cast(floor(sum(width)/count(*)) as bigint) centre, count(*) n from (
  select *, sum(c) over (partition by doc_id order by width, seq rows unbounded preceding) cluster from (
    select *, case when width-lag(width) over (partition by doc_id order by width, seq)<=8 then 0 else 1 end c from ocr_words) a) b group by 1,2""", "ocr_words"))
def _(v):
    return layout.cluster_values(v.ocr_words, ["doc_id"], "width")


@query("f16_join_row_words", with_ctes("""
select doc_id, seq//12 g, string_agg(case when prev is null then '' when lft-prev<=15 then '' else ' ' end||text, '' order by lft, top, seq) line
from (select *, lag(lft+width) over (partition by doc_id, seq//12 order by lft, top, seq) prev from ocr_words) q group by 1,2""", "ocr_words"))
def _(v):
    # Shuffled as they are: gathered before, words would be sorted and spilled on the map side too.
    src = layout.boxes(v.ocr_words.repartition("doc_id")).withColumn("g", F.floor(F.col("seq") / 12).cast("bigint"))
    words = F.collect_list(F.struct("lft", "top", "seq", "right", "text"))
    return src.groupBy("doc_id", "g").agg(words.alias("w")).select("doc_id", "g", layout.join_words(F.col("w")).alias("line"))


@query("j17_near_labels", with_ctes("""
select a.doc_id, arg_min(least(a.top,b.top), (a.seq,b.seq)) top from ocr_words a join ocr_words b on a.doc_id=b.doc_id and abs(a.top-b.top)<=80
where regexp_matches(a.text,'(?i)^the$') and regexp_matches(b.text,'(?i)^of$') group by 1""", "ocr_words"))
def _(v):
    return layout.near_labels(v.ocr_words, "^the$", "^of$")


@query("f23_clip_to_grid", with_ctes("""
select doc_id, count(*) n_words, min(top) first_top from ocr_words join (
  select doc_id, coalesce(min(top) filter (regexp_matches(text,'(?i)^signers$')), cast(floor(max(top+height)*0.44) as bigint)) g,
    arg_min(top, seq) filter (regexp_matches(text,'(?i)^declaration$')) d from ocr_words group by 1) e using (doc_id)
where top>=g and (d is null or top<d) group by 1""", "ocr_words"))
def _(v):
    return layout.clip_to_grid(v.ocr_words).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.min("top").alias("first_top"))


@query("f25_cause_titles", with_ctes("""
select doc_id, coalesce(cause,'') cause from ocr_pages left join (
  select doc_id, string_agg(text,' ' order by top, lft, seq) cause from (select w.*, row_number() over (partition by doc_id order by top, lft, seq) n
    from ocr_words w join ocr_pages using (doc_id) where top<page_height*0.15 and not regexp_matches(text,'^[0-9.:,-]+$') and length(text)>1) q where n<=8 group by 1) t using (doc_id)""", "ocr_words", "ocr_pages"))
def _(v):
    return layout.cause_titles(v.ocr_words, v.ocr_pages)


@query("f22_rows_by_bands", with_ctes(f"""
select doc_id, line_number, raw_name, raw_address, raw_date, signature_present, ocr_confidence from (
  select *, row_number() over (partition by doc_id order by g) line_number from (
    select doc_id, seq//24 g, coalesce(string_agg(text,' ' order by lft, top, seq) filter (cx<380),'') raw_name, coalesce(string_agg(text,' ' order by lft, top, seq) filter (cx>=380 and cx<740),'') raw_address,
      coalesce(string_agg(text,' ' order by lft, top, seq) filter (cx>=740 and cx<880),'') raw_date, coalesce(bool_or(cx>=880 and cx<1000),false) signature_present, {round_py('avg(conf)',1)} ocr_confidence,
      {'+'.join(f"max(contains(lower(text),'{h}')::int)" for h in ('name', 'address', 'date', 'signature', 'city', 'zip', 'state'))} heads
    from (select *, lft+width//2 cx from ocr_words) w group by 1,2) a where heads<3 and (raw_name<>'' or raw_address<>'')) b""", "ocr_words"))
def _(v):
    return layout.extract_by_bands(v.ocr_words, v.ocr_pages)


def anchors_sql(words: str) -> dict[str, str]:
    """CTEs ending in ``anchors``, the line-number words of the table ``words``."""
    return {
        "d": f"""select doc_id, seq, lft, top, lft+width as "right", top+height as bottom, regexp_extract(text,'^([1-8])\\.?$',1) digit
          from {words} where regexp_matches(text,'^[1-8]\\.?$')""",
        "refs": """select doc_id, lft r_lft, "right" r_right, min((digit_at, seq)) spot
          from d join (select doc_id, digit, min(seq) digit_at from d group by 1,2) s using (doc_id, digit) group by 1,2,3""",
        "best": """select * from (select r.doc_id, r_lft, r_right, any_value(spot) spot, count(distinct digit) n from refs r
          join (select distinct doc_id, lft, digit from d) s on r.doc_id=s.doc_id and s.lft between r_lft-80 and r_right+80 group by 1,2,3) c
          where n>=3 qualify row_number() over (partition by doc_id order by n desc, spot)=1""",
        "anchors": """select d.doc_id, digit, n n_digits, row_number() over (partition by d.doc_id, digit order by top, seq) nth, seq, top, lft, "right", bottom
          from d join best b on d.doc_id=b.doc_id and d.lft between r_lft-80 and r_right+80"""}


@query("a18_w13_number_anchors", with_ctes("select * from anchors", "ocr_words", extra={
    "numbered": "select * replace (case when seq%17=0 then cast(seq%8+1 as varchar) else text end as text) from ocr_words"} | anchors_sql("numbered")))
def _(v):
    numbered = v.ocr_words.withColumn("text", F.when(F.col("seq") % 17 == 0, (F.col("seq") % 8 + 1).cast("string")).otherwise(F.col("text")))
    return layout.number_anchors(numbered)


def forms(v: Views):
    """The documents' words under a printed header row, with a row number at every line."""
    heads = ["Signature", "Print", "Residence", "City", "Zip", "Date"]
    seq, n = F.col("seq"), F.col("seq")
    head = F.when(seq % 12 < 6, F.element_at(F.array(*[F.lit(h) for h in heads]), (seq % 12 + 1).cast("int")))
    first = F.floor(seq / 12) == 0
    return v.ocr_words.withColumns({
        "text": F.when(first, F.coalesce(head, F.col("text"))).when(n % 12 == 0, ((F.floor(seq / 12) - 1) % 8 + 1).cast("string")).otherwise(F.col("text")),
        "lft": F.when(first, seq % 12 * 160 + 40).otherwise(F.col("lft")), "top": F.col("top") * 6})


@query("a19_column_headers", with_ctes("""
select doc_id, max(lft) filter (f='sig') x_sig, max(lft) filter (f='name') x_name, max(lft) filter (f='addr') x_addr from (
  select doc_id, case lower(text) when 'signature' then 'sig' when 'print' then 'name' when 'residence' then 'addr' when 'city' then 'city' when 'zip' then 'zip' when 'date' then 'date' end f, min(lft) lft
  from (select doc_id, case seq%12 when 0 then 'Signature' when 1 then 'Print' when 2 then 'Residence' when 3 then 'City' when 4 then 'Zip' when 5 then 'Date' end as text, seq%12*160+40 lft
    from ocr_words where seq<6) q group by 1,2) z group by 1 having count(*)>=3""", "ocr_words"))
def _(v):
    return layout.column_headers(forms(v)).select("doc_id", "x_sig", "x_name", "x_addr")


@query("f24_rows_by_headers")
def _(v):
    return layout.extract_by_headers(forms(v), v.ocr_pages)


FORMS_SQL = """select * replace (case when seq<6 then ['Signature','Print','Residence','City','Zip','Date'][1+seq%12] when seq<12 then text
    when seq%12=0 then cast((seq//12-1)%8+1 as varchar) else text end as text, case when seq<12 then seq%12*160+40 else lft end as lft, top*6 as top) from ocr_words"""


@query("w14_blocks", with_ctes("""
select doc_id, idx, top, top-70 block_top, least(top+200, least(coalesce(next_top, top+200)-10, coalesce(nullif(decl,0)-10, top+200))) block_bottom
from (select *, row_number() over (partition by doc_id order by top, seq) idx, lead(top) over (partition by doc_id order by top, seq) next_top from anchors) a
left join (select doc_id, arg_min(top, seq) decl from forms where regexp_matches(text,'(?i)^declaration$') group by 1) s using (doc_id)""",
    "ocr_words", extra={"forms": FORMS_SQL} | anchors_sql("forms")))
def _(v):
    words = forms(v)
    return layout.blocks(layout.number_anchors(words), words).select("doc_id", "idx", "top", "block_top", "block_bottom")


@query("f24_rows_by_numbers")
def _(v):
    return layout.extract_by_numbers(forms(v), v.ocr_pages)


def labelled(v: Views):
    """Documents as label blocks: 'n Print Name: a b  Date: c' on every fourth line."""
    pos = F.col("seq") % 12
    line = F.floor(F.col("seq") / 12)
    text = (F.when(pos == 0, (line % 7 + 1).cast("string")).when(pos == 1, "Print").when(pos == 2, "Name:")
            .when(pos == 7, "Date:").otherwise(F.col("text")))
    return v.ocr_words.withColumns({"text": text, "top": F.col("top") * 6})


@query("f24_rows_by_blocks")
def _(v):
    return layout.extract_blocks(labelled(v), v.ocr_pages)


@query("u3_first_strategy_pages")
def _(v):
    words = forms(v).unionByName(labelled(v).withColumn("doc_id", F.col("doc_id") + 10000000))
    pages = v.ocr_pages.unionByName(v.ocr_pages.withColumn("doc_id", F.col("doc_id") + 10000000))
    return layout.extract_pages(words, pages)


@query("f24_words_after_label", with_ctes(r"""
select doc_id, label_seq, coalesce(trim(value),'') "value" from (select doc_id, seq label_seq from w where is_label) l left join (
  select doc_id, label_seq, string_agg(text,' ' order by lft, top, seq) filter (case when any_beside then beside else under and top-first_top<=20 end) as value
  from (select *, min(top) filter (under) over (partition by doc_id, label_seq) first_top, bool_or(beside) over (partition by doc_id, label_seq) any_beside from near) n
  group by 1,2) f using (doc_id, label_seq)""", "ocr_words", extra={
    "w": r"""select *, lft+width as r, top+height//2 cy, top+height bottom, regexp_matches(text,'(?i)^date:?$') is_label,
       regexp_matches(trim(text,':'),'(?i)^(print|name|residence|address|city|state|zip|date|signature|only|res\.?)$') is_word from (
       select * replace (case seq%12 when 0 then cast((seq//12)%7+1 as varchar) when 1 then 'Print' when 2 then 'Name:' when 7 then 'Date:' else text end as text, top*6 as top) from ocr_words) z""",
    # A label looks into the bands of 100 pixels that its window touches.
    "near": """select l.doc_id, label_seq, x.seq, x.text, x.lft, x.top, true beside, false under
       from (select doc_id, seq label_seq, cy, r, unnest(range((cy-20)//100, (cy+20)//100+1)) band from w where is_label) l
       join (select *, cy//100 band from w where not is_word) x using (doc_id, band) where abs(x.cy-l.cy)<=20 and x.lft>l.r+5
     union all select l.doc_id, label_seq, x.seq, x.text, x.lft, x.top, false, true
       from (select doc_id, seq label_seq, bottom, unnest(range(bottom//100, (bottom+80)//100+1)) band from w where is_label) l
       join (select *, top//100 band from w where not is_word) x using (doc_id, band) where x.top>l.bottom and x.top<=l.bottom+80"""}))
def _(v):
    return layout.words_after_label(labelled(v), "^date:?$")


@query("f15_strip_labels", with_ctes(r"""
select doc_id, seq, trim(regexp_replace(regexp_replace(text,'(?i)\b(print|name|signature|address|residence|only|city|zip|state|date)\b','','g'),'\s+',' ','g'),' :.,-_') stripped from ocr_words""", "ocr_words"))
def _(v):
    return v.ocr_words.select("doc_id", "seq", tx.strip_form_labels(F.col("text")).alias("stripped"))
