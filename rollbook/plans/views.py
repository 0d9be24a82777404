"""Stand-in inputs: the sheet, registry and field tables derived from the given tables.

A site that has its own ``lines`` or ``roll`` tables passes those to the operators
instead; nothing else in the package depends on this module.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import valid_zip5, with_split_address

# Vocabulary of the derived people and streets.
FIRST = "jane,john,maria,bob,alice,luis,mei,omar,ana,paul,ruth,ivan,kim,noah,tara,zoe"
LAST = ("smith,doe,garcia,johnson,brown,lopez,chen,khan,silva,miller,cohen,petrov,lee,wilson,"
        "patel,meyer,davis,moore,clark,young,hall,allen,king,scott")
STREETS = "main,oak,pine,elm,maple,cedar,lake,hill,park,river,sunset,mission"
KINDS = "st,ave,rd,blvd"
ROLES = "worker,petitioner,field_manager,office_worker,boss"


def _pick(words: str, index: Column) -> Column:
    return F.split_part(F.lit(words), F.lit(","), index.cast("int") + 1)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _count(self, name: str) -> Column:
        return self.table(name).agg(F.count(F.lit(1))).scalar()

    @cached_property
    def roll(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("roll_pos"),
                F.concat(F.lit("V"), F.lpad(key.cast("string"), 6, "0")).alias("voter_id"),
                _pick(FIRST, key % 16).alias("first_name"),
                _pick(LAST, F.floor(key / 16) % 24).alias("last_name"),
                F.concat((100 + (key * 13) % 900).cast("string"), F.lit(" "),
                         _pick(STREETS, (key * 11) % 12), F.lit(" "),
                         _pick(KINDS, key % 4)).alias("street_address"),
                F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("city"),
                F.lit("ca").alias("state"),
                (90000 + (key * 37) % 6200).cast("string").alias("zip_code")))

    @cached_property
    def lines_num(self) -> DataFrame:
        order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
        return (
            self.table("lineitem").select(*order, "l_returnflag")
            .withColumn("project_id", F.floor(F.col("l_orderkey") / 8).cast("bigint"))
            .withColumn("line_number", F.row_number().over(
                Window.partitionBy("project_id").orderBy(*order)).cast("int")))

    @cached_property
    def lines(self) -> DataFrame:
        """One row per sheet line, with the registry person behind it."""
        quantity = F.col("l_quantity")
        empty = (F.col("l_linenumber") == 7) & (quantity < 10)
        full = F.concat("first_name", F.lit(" "), "last_name")
        person = (self.lines_num
                  .withColumn("person", (F.col("project_id") * 5 + F.col("l_partkey") % 400) % self._count("customer")))
        return (
            person.join(self.roll.withColumnRenamed("roll_pos", "person"), "person")
            .select(
                "project_id", F.lit(1).alias("page"), "line_number",
                F.when(empty, "").when(quantity % 7 == 0, F.replace(full, F.lit("o"), F.lit("0")))
                .when(quantity % 11 == 0, F.concat("last_name", F.lit(", "), "first_name"))
                .otherwise(full).alias("raw_name"),
                F.when(empty, "").otherwise(F.concat(
                    "street_address", F.lit(", "), "city", F.lit(", CA "), "zip_code")).alias("raw_address"),
                F.col("l_shipdate").cast("date").cast("string").alias("raw_date"),
                (F.col("l_returnflag") != "R").alias("signature_present"),
                (50 + F.col("l_discount") * 400).alias("ocr_confidence"),
                F.col("voter_id").alias("true_voter_id")))

    @cached_property
    def projects(self) -> DataFrame:
        pid = F.floor(F.col("o_orderkey") / 8).cast("bigint")
        return (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(pid.alias("project_id"))
            .agg(F.min("o_orderdate").alias("created_at"),
                 F.min("o_orderpriority").alias("cause"), F.min(F.lower("r_name")).alias("county"))
            .withColumn("cause", F.when(F.col("project_id") % 10 == 0, "").otherwise(F.col("cause")))
            .withColumn("county", F.when(F.col("project_id") % 7 == 0, "").otherwise(F.col("county"))))

    @cached_property
    def workers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("worker_id"),
            F.concat(_pick(FIRST, key % 16), F.lit(" "), _pick(LAST, (key * 5) % 24)).alias("full_name"),
            _pick(ROLES, key % 5).alias("role"),
            (18 + key % 12).cast("double").alias("hourly_wage"),
            (key % 9 != 4).alias("is_active"),
            F.when(key % 6 == 0, None).otherwise(F.col("s_nationkey") % 5).alias("team_id"))

    @cached_property
    def teams(self) -> DataFrame:
        """Five teams; the manager is the lowest worker id of the team."""
        return (self.workers.where("team_id is not null").groupBy("team_id")
                .agg(F.min("worker_id").alias("manager_id"))
                .withColumn("team_name", F.concat(F.lit("team "), F.col("team_id").cast("string"))))

    @cached_property
    def assignments(self) -> DataFrame:
        return self.projects.select(
            "project_id", (F.col("project_id") % self._count("supplier")).alias("worker_id"),
            F.col("created_at").alias("assigned_at"))

    @cached_property
    def _events(self) -> DataFrame:
        return self.table("events").withColumn("worker_id", F.col("user_id") % self._count("supplier"))

    @cached_property
    def shifts(self) -> DataFrame:
        minutes = F.floor("value").cast("bigint") % 600 + 30
        return self._events.where(F.col("event_type").isin("view", "signup")).select(
            F.col("event_id").alias("shift_id"), "worker_id", F.col("ts").alias("clock_in"),
            F.when(F.col("event_id") % 17 == 0, None)
            .otherwise(F.timestamp_add("MINUTE", minutes, F.col("ts"))).alias("clock_out"),
            (F.weekday("ts") >= 5).alias("is_weekend"),
            (F.col("event_id") % 3 == 0).alias("approved"))

    @cached_property
    def live_events(self) -> DataFrame:
        return self._events.where("event_type = 'click'").select(
            "worker_id", "ts", "event_id", F.floor("value").cast("bigint").alias("sig_count"))

    @cached_property
    def pins(self) -> DataFrame:
        gone = F.col("event_id") % 10 == 0
        return self._events.where("event_type = 'error'").select(
            "event_id", "worker_id", "ts",
            F.when(~gone, F.col("value") % 180 - 90).alias("lat"),
            F.when(~gone, (F.col("value") * 3) % 360 - 180).alias("lng"))

    @cached_property
    def punches(self) -> DataFrame:
        return self._events.where(F.col("event_type").isin("view", "purchase")).select(
            "event_id", "worker_id", "ts",
            F.when(F.col("event_type") == "view", "in").otherwise("out").alias("kind"))

    @cached_property
    def pay_periods(self) -> DataFrame:
        """Calendar weeks that hold events, numbered in order; the last two are open."""
        week = F.to_date(F.date_trunc("week", "ts"))
        return (
            self.table("events").select(week.alias("monday")).distinct()
            .select(
                F.datediff("monday", F.lit("2023-12-25")).cast("bigint").alias("pay_period_id"),
                F.col("monday").cast("string").alias("start_date"),
                F.date_add("monday", 6).cast("string").alias("end_date"),
                F.when(F.col("monday") >= "2024-01-22", "open").otherwise("closed").alias("status")))

    @cached_property
    def county_cities(self) -> DataFrame:
        return self.table("region").join(self.table("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.lower("r_name").alias("county"), F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("city"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        pages = self.table("pages").select("page_id", F.md5("url").alias("h"))
        return pages.select(F.col("page_id").alias("packet_id"), F.substring("h", 1, 16).alias("fp")).unionAll(
            pages.where("page_id % 5 = 0").select(
                (F.col("page_id") + 1000000).alias("packet_id"),
                F.concat(F.lit("0"), F.substring("h", 2, 15)).alias("fp")))

    @cached_property
    def vectors(self) -> DataFrame:
        base = self.table("embeddings").select(
            "vec_id", F.floor(F.col("vec_id") / 20).cast("bigint").alias("project_id"), F.col("embedding").alias("v"))
        shifted = base.where("vec_id % 10 = 0").select(
            (F.col("vec_id") + 1000000).alias("vec_id"), "project_id",
            F.transform("v", lambda x: (x + 0.001).cast("float")).alias("v"))
        return base.unionAll(shifted)

    @cached_property
    def ocr_words(self) -> DataFrame:
        inner = self.table("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("seq", "text"))
        seq = F.col("seq")
        return inner.where("text <> ''").select(
            "doc_id", "seq", "text", (seq % 12 * 80).alias("lft"),
            (F.floor(seq / 12).cast("bigint") * 30 + seq % 3).alias("top"),
            (8 * F.length("text")).alias("width"), F.lit(20).alias("height"), (50 + seq % 50).alias("conf"))

    @cached_property
    def packet_lines(self) -> DataFrame:
        """Review rows: sheet lines with split address and a row status."""
        full = F.replace("raw_address", F.lit(", CA "), F.lit(", "))
        n = F.col("line_number")
        short = F.when(n % 11 == 0, F.substring("z", 1, 4)).otherwise(F.col("z"))
        return (
            with_split_address(self.lines, full, "raw_street", "raw_city", "z")
            .select(
                F.col("project_id").alias("packet_id"), n.alias("line_no"),
                F.when((F.col("raw_name") == "") & (F.col("raw_street") == ""), "blank")
                .when(n % 9 == 0, "already_counted").when(n % 13 == 0, "changed_needs_review")
                .otherwise("new_signature").alias("row_status"),
                "raw_name", F.upper("raw_name").alias("norm_name"),
                F.col("raw_street").alias("raw_address"), F.upper("raw_street").alias("norm_address"),
                "raw_city", short.alias("raw_zip"), valid_zip5(short).alias("valid_zip"), "raw_date",
                F.col("signature_present").alias("has_signature")))

    @cached_property
    def signatures(self) -> DataFrame:
        """Sheet lines with an automatic status and, where a label exists, a staff override."""
        n, conf = F.col("line_number"), F.col("ocr_confidence")
        label = self.table("labels").select(
            F.col("doc_id").alias("_doc"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("staff_override"))
        src = self.lines.withColumn("_doc", F.col("project_id") * 32 + n).withColumn(
            "status", F.when((F.col("raw_name") == "") & (F.col("raw_address") == ""), "rejected").when(n % 17 == 0, "duplicate")
            .when((conf >= 70) & F.col("signature_present"), "approved").when(conf >= 58, "review").otherwise("rejected"))
        return src.join(label, "_doc", "left").drop("_doc")

    @cached_property
    def headers(self) -> DataFrame:
        n = lambda s: F.count_if(F.col("status") == s)
        return self.signatures.groupBy("project_id").agg(
            F.count(F.lit(1)).alias("total_lines"), n("approved").alias("approved"), n("review").alias("review"),
            n("rejected").alias("rejected"), n("duplicate").alias("duplicates"),
            F.count_if(~F.col("signature_present") & (F.col("raw_name") != "")).alias("fraud_flagged_lines"))

    @cached_property
    def sheets(self) -> DataFrame:
        return self.projects.join(self.headers, "project_id")

    @cached_property
    def hand_counts(self) -> DataFrame:
        return self.live_events.select(
            F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("project_id"), "worker_id",
            (F.col("sig_count") % 90 + 1).alias("sig_count"), F.lit("hand").alias("notes"), F.col("ts").alias("entered_at"))

    @cached_property
    def entries(self) -> DataFrame:
        return self.hand_counts.select("project_id", "worker_id", F.lit("[manual entry]").alias("pdf_path"),
                                       F.col("sig_count").alias("approved"), F.col("entered_at").alias("created_at"))

    @cached_property
    def packet_review(self) -> DataFrame:
        """Packet rows in review: match, verdict, flags, decision and action columns."""
        n = F.col("line_no")
        conf = ((F.col("packet_id") * 7 + n * 13) % 101).cast("int")
        return self.packet_lines.select(
            "*", conf.alias("voter_confidence"),
            F.when(conf >= 72, "valid").when(conf >= 45, "uncertain").otherwise("invalid").alias("voter_status"),
            F.concat(F.lit("entry "), conf.cast("string")).alias("voter_reason"),
            F.when((F.col("row_status") == "new_signature") & F.col("has_signature"), "likely_valid")
            .when(~F.col("has_signature") & (F.col("row_status") != "blank"), "likely_invalid").otherwise("needs_review").alias("ai_verdict"),
            F.when(n % 8 == 0, '["low_confidence"]').when(n % 31 == 0, "not json").when(n % 19 == 0, None).otherwise("[]").alias("flags_json"),
            F.when(n % 10 == 0, '["similar_name","invalid_zip"]').otherwise("[]").alias("fraud_flags"),
            F.when(n % 10 == 0, 50).otherwise(0).alias("fraud_score"),
            F.when(n % 14 == 0, "confirmed_fraud").when(n % 15 == 0, "cleared").alias("review_decision"),
            F.when(n % 12 == 0, "rejected").alias("action"))

    @cached_property
    def extraction_pairs(self) -> DataFrame:
        """Two readings of each line: as written (a) and from the registry (b), with confidences."""
        full = F.replace("raw_address", F.lit(", CA "), F.lit(", "))
        r = self.roll.select(F.col("voter_id").alias("true_voter_id"), "first_name", "last_name", "street_address",
                             F.col("city").alias("r_city"), F.col("zip_code").alias("r_zip"))
        n = F.col("line_number")
        a_conf = F.col("ocr_confidence").cast("int")
        b_conf = (50 + (n * 7) % 45).cast("int")
        fields = ["name", "address", "city", "zip_code"]
        return with_split_address(self.lines, full, "_s", "_c", "_z").join(r, "true_voter_id").select(
            "project_id", "line_number", F.col("raw_name").alias("a_name"), F.col("_s").alias("a_address"),
            F.when(n % 5 == 0, "").otherwise(F.col("_c")).alias("a_city"), F.col("_z").alias("a_zip_code"),
            F.when(n % 6 == 0, "").otherwise(F.concat(F.initcap("first_name"), F.lit(" "), F.initcap("last_name"))).alias("b_name"),
            F.when(n % 4 == 0, F.split_part("street_address", F.lit(" "), F.lit(2))).otherwise(F.col("street_address")).alias("b_address"),
            F.initcap("r_city").alias("b_city"), F.when(n % 3 == 0, F.substring("r_zip", 1, 4)).otherwise(F.col("r_zip")).alias("b_zip_code"),
            *[a_conf.alias(f"a_{f}_confidence") for f in fields], *[b_conf.alias(f"b_{f}_confidence") for f in fields])

    @cached_property
    def ocr_pages(self) -> DataFrame:
        return self.ocr_words.groupBy("doc_id").agg(
            F.lit(1000).alias("page_width"), F.max(F.col("top") + F.col("height")).alias("page_height"))

    @cached_property
    def page_rows(self) -> DataFrame:
        """The rows of every fingerprinted page; copies carry a mangled first name."""
        src = self.lines.select(
            F.col("project_id").alias("_p"), F.col("line_number").alias("line_no"), "raw_name", "raw_address")
        pages = self.fingerprints.select("packet_id", (F.col("packet_id") % 1000000).alias("_p"))
        name = F.when((F.col("packet_id") >= 1000000) & (F.col("line_no") % 3 == 0),
                      F.concat(F.lit("zz"), F.col("raw_name"))).otherwise(F.col("raw_name"))
        street = F.split_part("raw_address", F.lit(","), F.lit(1))
        return pages.join(src, "_p").select(
            "packet_id", "line_no", F.when(F.col("raw_name") == "", "blank").otherwise("new_signature").alias("row_status"),
            F.concat(F.upper(F.concat(name, F.lit("|"), street)), F.lit("#"),
                     F.substring(F.md5(F.col("raw_address")), 1, 9)).alias("row_fingerprint"))

    @cached_property
    def rescans(self) -> DataFrame:
        """A later upload of every sheet: some names read differently, blank lines now filled."""
        return self.lines.select(
            (F.col("project_id") + 1000000).alias("project_id"), "line_number",
            F.when(F.col("raw_name") == "", "new signer").when(F.col("line_number") % 4 == 0, F.replace("raw_name", F.lit("a"), F.lit("@")))
            .otherwise(F.col("raw_name")).alias("raw_name"),
            F.when(F.col("raw_address") == "", "1 new st").otherwise(F.col("raw_address")).alias("raw_address"))

    @cached_property
    def rescan_sheets(self) -> DataFrame:
        return self.projects.withColumn("project_id", F.col("project_id") + 1000000)
