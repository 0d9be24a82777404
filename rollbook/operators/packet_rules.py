"""Risk flags and scores of review packets, and the review-state predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..session import cut
from .sheet_rules import DOMINANT_SHARE, MIN_LINES, dominant_value
from .similar import DIRECT_TEXTS, similar_by_sequence

# Points of each flag, cap, run and gap sizes.
POINTS = {"no_signature": 30, "invalid_zip": 15, "city_not_in_county": 80, "consecutive_addresses": 40,
          "long_city_run": 20, "similar_name": 35, "uniform_date": 15}
MAX_SCORE = 100
RUN_OF_CITY, MAX_STEP = 5, 6
NAME_RATIO = 0.88
# Accepted actions and decisions.
ACTIONS = ["approved", "rejected", "escalated"]
DECISIONS = ["confirmed_fraud", "cleared"]

KEY = ["packet_id", "line_no"]


def active(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("row_status") != "blank") & (F.coalesce("raw_name", F.lit("")) != ""))


def _flag(df: DataFrame, flag: str | Column, points: int) -> DataFrame:
    return df.select(*KEY, (F.lit(flag) if isinstance(flag, str) else flag).alias("flag"), F.lit(points).alias("points"))


def _city() -> Column:
    return tx.strip(F.lower(F.coalesce("raw_city", F.lit(""))))


def unsigned_rows(lines: DataFrame) -> DataFrame:
    return _flag(lines.where((F.col("row_status") == "new_signature") & ~F.col("has_signature")),
                 "no_signature", POINTS["no_signature"])


def invalid_zips(lines: DataFrame) -> DataFrame:
    return _flag(lines.where((F.coalesce("raw_zip", F.lit("")) != "") & ~F.col("valid_zip")),
                 "invalid_zip", POINTS["invalid_zip"])


def with_city_check(lines: DataFrame, county_cities: DataFrame, city: str, county: str) -> DataFrame:
    """Append city_ok: blank input and unknown counties pass, else the pair must be listed."""
    dim = county_cities.select(F.col("county").alias("_county"), F.lower(tx.strip(F.col("city"))).alias("_c")).distinct()
    known = dim.select("_county").distinct().withColumn("_known", F.lit(True))
    pairs = dim.withColumn("_listed", F.lit(True))
    src = lines.withColumns({"_county": F.coalesce(F.col(county), F.lit("")),
                             "_c": F.lower(tx.strip(F.coalesce(F.col(city), F.lit(""))))})
    out = src.join(known, "_county", "left").join(pairs, ["_county", "_c"], "left")
    passes = ((F.coalesce(F.col(city), F.lit("")) == "") | (F.col("_county") == "")
              | F.col("_known").isNull() | F.col("_listed").isNotNull())
    return out.withColumn("city_ok", passes).select(*lines.columns, "city_ok")


def foreign_cities(lines: DataFrame, counties: DataFrame, county_cities: DataFrame) -> DataFrame:
    """Rows naming a city outside the packet's county (``counties``: packet_id, county)."""
    placed = active(lines).join(counties.where(F.coalesce("county", F.lit("")) != "").select("packet_id", "county"), "packet_id")
    checked = with_city_check(placed, county_cities, "raw_city", "county").where(~F.col("city_ok"))
    return _flag(checked, tx.county_flag(F.col("county")), POINTS["city_not_in_county"])


def near_sequences(lines: DataFrame, step: int = MAX_STEP) -> DataFrame:
    """Rows in three or more house numbers of a city with no gap above ``step``.

    Three successive sorted rows whose two gaps are small form a hit, so the hits are
    the chains of three rows and more. Chains are cut over distinct numbers, each with
    its rows: repeats are gaps of 0, and a window holds one city's numbers at most. Rows
    are read and shuffled once, by city of a packet; nothing is joined back.
    """
    numbered = active(lines).select(
        *KEY, _city().alias("city"),
        F.regexp_extract(tx.strip(F.coalesce("raw_address", F.lit(""))), r"^(\d+)", 1).try_cast("decimal(38,0)").alias("num"))
    numbered = numbered.where("num is not null")
    place = ["packet_id", "city"]
    w = Window.partitionBy(*place).orderBy("num")
    nums = numbered.repartition(*place).groupBy(*place, "num").agg(F.collect_list("line_no").alias("line_nos"))
    cuts = nums.withColumn("cut", (F.coalesce(F.col("num") - F.lag("num").over(w), F.lit(step + 1)) > step).cast("int"))
    chains = cuts.withColumn("chain", F.sum("cut").over(w))
    long = chains.withColumn("rows", F.sum(F.size("line_nos")).over(Window.partitionBy(*place, "chain"))).where("rows >= 3")
    hit = long.select("packet_id", F.explode("line_nos").alias("line_no"))
    return _flag(hit, "consecutive_addresses", POINTS["consecutive_addresses"])


def city_runs(lines: DataFrame, run: int = RUN_OF_CITY, chunk_rows: int = 4096) -> DataFrame:
    """Rows in ``run`` or more adjacent active rows with one city (blank counts as a city).

    Runs are cut inside chunks of line numbers first; only the outer runs of a chunk,
    which may go on in the next one, meet again per packet. So even one huge packet is
    spread over many tasks. Lines are read once; their runs are written and read again.
    """
    src = active(lines).select(*KEY, _city().alias("city"), F.floor(F.col("line_no") / chunk_rows).alias("chunk"))
    part = ["packet_id", "chunk"]
    w = Window.partitionBy(*part).orderBy("line_no")
    prev = F.lag("city").over(w)
    rows = src.withColumn("cut", F.when(prev == F.col("city"), 0).otherwise(1)).withColumn("piece", F.sum("cut").over(w))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*part, "piece"))).withColumn(
        "edge", (F.col("piece") == 1) | (F.col("piece") == F.max("piece").over(Window.partitionBy(*part))))
    rows = cut(rows.select(*KEY, "chunk", "piece", "n", F.when(F.col("edge"), F.col("city")).alias("city"), "edge"))
    edge = rows.where("edge").groupBy(*part, "piece").agg(
        F.any_value("n").alias("n"), F.min("line_no").alias("start"), F.any_value("city").alias("city"))
    across = Window.partitionBy("packet_id").orderBy("start")
    goes_on = (F.lag("city").over(across) == F.col("city")) & (F.lag("chunk").over(across) != F.col("chunk"))
    edge = edge.withColumn("cut", F.when(goes_on, 0).otherwise(1)).withColumn("joined", F.sum("cut").over(across))
    whole = edge.withColumn("total", F.sum("n").over(Window.partitionBy("packet_id", "joined")))
    grown = whole.where((F.col("n") < run) & (F.col("total") >= run)).select(*part, "piece")
    hit = rows.where(F.col("n") >= run).select(*KEY).unionByName(
        rows.where(F.col("edge") & (F.col("n") < run)).join(grown, [*part, "piece"], "left_semi").select(*KEY))
    return _flag(hit, "long_city_run", POINTS["long_city_run"])


def similar_names(lines: DataFrame, ratio: float = NAME_RATIO, direct: int = DIRECT_TEXTS) -> DataFrame:
    named = active(lines).select(*KEY, F.upper(tx.or_else(F.col("norm_name"), F.col("raw_name"))).alias("who"))
    return _flag(similar_by_sequence(named, *KEY, "who", ratio, direct), "similar_name", POINTS["similar_name"])


def uniform_dates(lines: DataFrame, share: float = DOMINANT_SHARE, min_lines: int = MIN_LINES) -> DataFrame:
    """Rows with the date that holds most dated active rows of the packet."""
    dated = active(lines).where(F.coalesce("raw_date", F.lit("")) != "")
    top = dominant_value(dated, F.col("raw_date"), ["packet_id"], min_lines, share)
    hit = dated.join(top.select("packet_id", F.col("shared").alias("raw_date")), ["packet_id", "raw_date"])
    return _flag(hit, "uniform_date", POINTS["uniform_date"])


def packet_flags(lines: DataFrame, counties: DataFrame, county_cities: DataFrame, direct: int = DIRECT_TEXTS) -> DataFrame:
    """One row per (packet_id, line_no, flag) with its points; a flag counts once a row."""
    out = unsigned_rows(lines)
    for part in (invalid_zips(lines), foreign_cities(lines, counties, county_cities), near_sequences(lines),
                 city_runs(lines), similar_names(lines, direct=direct), uniform_dates(lines)):
        out = out.unionByName(part)
    return out


def score_packets(lines: DataFrame, flags: DataFrame, cap: int = MAX_SCORE) -> DataFrame:
    """Every row with its sorted flags and capped score."""
    per = flags.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("flag")).alias("fraud_flags"), F.sum("points").alias("points"))
    out = lines.join(per, KEY, "left")
    return out.withColumns({
        "fraud_flags": F.coalesce("fraud_flags", F.expr("array()").cast("array<string>")),
        "fraud_score": F.least(F.lit(cap), F.coalesce("points", F.lit(0))).cast("int")}).drop("points")


def merge_outside_flags(scored: DataFrame, outside: DataFrame) -> DataFrame:
    """Add flags of ``outside`` (packet_id, line_no, flags, score) that are new; keep the higher score."""
    o = outside.select(*KEY, F.col("flags").alias("_f"), F.col("score").alias("_s"))
    out = scored.join(o, KEY, "left")
    merged = vl.append_new(F.col("fraud_flags"), F.coalesce("_f", F.expr("array()").cast("array<string>")))
    return out.withColumns({
        "fraud_flags": merged,
        "fraud_score": F.when(F.col("_s").isNull(), F.col("fraud_score")).otherwise(
            F.least(F.lit(MAX_SCORE), F.greatest("fraud_score", "_s"))).cast("int")}).drop("_f", "_s")


# ── review state ─────────────────────────────────────────────────────────────

def effective_status(override: Column, status: Column) -> Column:
    return tx.or_else(override, status)


def bulk_approvable(flags_json: str = "flags_json", fraud_json: str = "fraud_flags") -> Column:
    """May approve-all take this row? Unreadable flag lists count as flagged."""
    clear = lambda c: F.coalesce(F.size(vl.json_list(F.col(c))) == 0, F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return ((text("row_status") == "new_signature") & (text("action") == "")
            & F.coalesce("has_signature", F.lit(False)) & (text("ai_verdict") != "likely_invalid")
            & (text("voter_status") == "valid") & clear(flags_json) & clear(fraud_json)
            & (F.coalesce("fraud_score", F.lit(0)) == 0) & (text("review_decision") != "confirmed_fraud"))


def approve_all(lines: DataFrame, reviewer: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Set action (and reviewer and time) on every row that may be approved in bulk."""
    ok = bulk_approvable()
    out = lines.withColumn("_ok", ok).withColumn("action", F.when(F.col("_ok"), "approved").otherwise(F.col("action")))
    if reviewer is not None:
        before = F.col("reviewed_by") if "reviewed_by" in lines.columns else F.lit(None)
        out = out.withColumn("reviewed_by", F.when(F.col("_ok"), reviewer).otherwise(before))
    if as_of is not None:
        before = F.col("reviewed_at") if "reviewed_at" in lines.columns else F.lit(None)
        out = out.withColumn("reviewed_at", F.when(F.col("_ok"), as_of).otherwise(before))
    return out.drop("_ok")


def export_filter(kind: str) -> Column:
    """Row filter of a packet export: all, valid or flagged."""
    confirmed = F.coalesce(F.col("review_decision") == "confirmed_fraud", F.lit(False))
    if kind == "valid":
        return F.coalesce(F.col("voter_status") == "valid", F.lit(False)) & ~confirmed
    if kind == "flagged":
        return (F.coalesce("fraud_score", F.lit(0)) > 30) | confirmed
    return F.col("row_status") != "blank"


def packet_summary(lines: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("row_status") == s)
    return lines.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("total_rows"), n("new_signature").alias("new_signatures"),
        n("already_counted").alias("previously_counted"), n("changed_needs_review").alias("needs_review"),
        n("blank").alias("blank"))


def outcome_counts(lines: DataFrame) -> DataFrame:
    """Per packet: matched rows by band, flagged rows and approved rows."""
    n = lambda s: F.count_if(F.col("voter_status") == s)
    return lines.groupBy("packet_id").agg(
        F.count("voter_status").alias("matched"), n("valid").alias("valid"), n("uncertain").alias("uncertain"),
        n("invalid").alias("invalid"), F.count_if(F.col("fraud_score") > 0).alias("flagged"),
        F.count_if(F.col("action") == "approved").alias("approved"))


def first_verdict(row_status: Column, signed: Column) -> Column:
    return (F.when((row_status == "new_signature") & signed, "likely_valid")
            .when(~signed & (row_status != "blank"), "likely_invalid").otherwise("needs_review"))
