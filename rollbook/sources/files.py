"""Documents in, tables in, results out."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import or_else
from ..operators.packet_rules import effective_status, export_filter
from . import buckets

# Accepted suffixes and the size limit.
SHEET_SUFFIXES = [".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".heic", ".heif"]
ROLL_SUFFIXES = [".csv", ".txt"]
MAX_UPLOAD_BYTES = 25 * 1024 * 1024

LINE_COLUMNS = ["line_number", "page", "raw_name", "raw_address", "raw_date", "signature_present", "first_name",
                "last_name", "street", "city", "state", "zip_code", "voter_id", "voter_name", "voter_address",
                "match_confidence", "name_score", "address_score"]


def scan_documents(spark: SparkSession, folder: str, glob: str = "*.{pdf,PDF}") -> DataFrame:
    """path, modificationTime, length, content of the documents of a folder.

    Spark's scan passes over files of no bytes; rows of uploads that came another way are told so by ``admit_uploads``.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def admit_uploads(files: DataFrame, allowed: list[str] = SHEET_SUFFIXES, default_name: str = "upload.pdf",
                  max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Append filename, suffix and reject_reason (null when admitted) from path and length."""
    suffix = lambda name: F.lower(F.regexp_extract(name, r"[^.](\.[^./]+)$", 1))
    base = or_else(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(default_name))
    fallback = "." + default_name.rsplit(".", 1)[-1]
    own = suffix(base)
    out = files.withColumns({
        "filename": F.when(own == "", F.concat(base, F.lit(fallback))).otherwise(base),
        "suffix": F.when(own == "", fallback).otherwise(own)})
    return out.withColumn("reject_reason", F.when(~F.col("suffix").isin(allowed), "unsupported_type")
                          .when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large"))


def split_admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.where("reject_reason is null").drop("reject_reason"), files.where("reject_reason is not null")


def jdbc_options(url: str) -> dict[str, str]:
    """Reader options of a database URL; postgres:// and postgresql:// mean the same."""
    u = urlsplit(url)
    scheme = u.scheme.split("+")[0]
    if scheme == "sqlite":
        return {"url": f"jdbc:sqlite:{u.path[1:]}", "driver": "org.sqlite.JDBC"}
    if scheme not in ("postgres", "postgresql"):
        raise ValueError(f"unsupported database URL scheme {scheme!r}")
    out = {"url": f"jdbc:postgresql://{u.hostname}:{u.port or 5432}{u.path}", "driver": "org.postgresql.Driver"}
    if u.username:
        out["user"] = unquote(u.username)
    if u.password:
        out["password"] = unquote(u.password)
    return out


def read_table(spark: SparkSession, location: str, table: str, split_column: str | None = None,
               lower: int = 0, upper: int = 0, splits: int = 1) -> DataFrame:
    """A table under a Parquet folder, or of a database read in ``splits`` ranges."""
    if "://" in location and location.split("://")[0].split("+")[0] in ("postgres", "postgresql", "sqlite"):
        reader = spark.read.format("jdbc").options(**jdbc_options(location)).option("dbtable", table)
        if split_column:
            reader = reader.options(partitionColumn=split_column, lowerBound=lower, upperBound=upper, numPartitions=splits)
        return reader.load()
    return spark.read.parquet(f"{location.rstrip('/')}/{table}")


def save_sheets(lines: DataFrame, path: str) -> None:
    """Replace the stored lines of every sheet in ``lines``; other sheets stay untouched.

    Sheets lie in buckets (``buckets.read_buckets`` reads them), so the number of files does not follow theirs, and a
    write that breaks off changes nothing.
    """
    buckets.change(lines, path, ["project_id"], buckets.replace_groups("project_id"))


def line_export(signatures: DataFrame) -> DataFrame:
    """Sheet lines with effective and automatic status, in export order."""
    have = [F.col(c) if c in signatures.columns else F.lit(None).alias(c) for c in LINE_COLUMNS]
    note = F.coalesce("staff_notes", F.lit("")) if "staff_notes" in signatures.columns else F.lit("")
    dup = F.col("duplicate_of_line") if "duplicate_of_line" in signatures.columns else F.lit(None).cast("int").alias("duplicate_of_line")
    return signatures.select(
        "project_id", *have, effective_status(F.col("staff_override"), F.col("status")).alias("status"),
        F.col("status").alias("auto_status"), dup, note.alias("staff_notes"))


def packet_export(lines: DataFrame, kind: str = "all") -> DataFrame:
    """Packet rows of an export (all, valid, flagged); flags joined by '|'."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return lines.where(export_filter(kind)).select(
        "packet_id", "line_no", F.col("raw_name").alias("name"), F.col("raw_address").alias("address"),
        F.col("raw_city").alias("city"), F.col("raw_zip").alias("zip"), F.col("raw_date").alias("date"), "has_signature",
        text("voter_status").alias("voter_status"),
        F.when(F.coalesce("voter_confidence", F.lit(0)) == 0, "").otherwise(text("voter_confidence")).alias("voter_confidence"),
        text("voter_reason").alias("voter_reason"), F.coalesce("fraud_score", F.lit(0)).alias("fraud_score"),
        F.array_join("fraud_flags", "|").alias("fraud_flags"), text("review_decision").alias("review_decision"),
        text("action").alias("action"))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def result_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as (keys, json)."""
    return df.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ── rows delivered by outside extraction ─────────────────────────────────────

ROW_SCHEMA = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def rows_from_json(pages: DataFrame, start: str = "line_start") -> DataFrame:
    """Sheet lines of (doc_id, page, rows_json): alias keys, empty rows dropped.

    The line number follows the printed row number when that is 1 to 8, else the
    count of rows kept before it on the page.
    """
    first = F.col(start) if start in pages.columns else F.lit(1)
    get = lambda *names: F.coalesce(*[F.try_element_at(F.col("m"), F.lit(n)) for n in names], F.lit(""))
    rows = pages.select("doc_id", "page", first.alias("_start"),
                        F.posexplode(F.from_json("rows_json", ROW_SCHEMA)).alias("i", "m")).where("m is not null")
    rows = rows.withColumns({
        "raw_name": F.trim(get("print_name", "name")), "address": F.trim(get("address")), "city": F.trim(get("city")),
        "zip": F.trim(get("zip"))}).where("raw_name <> '' or address <> ''")
    from pyspark.sql import Window
    kept = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("i")) - 1
    stated = F.coalesce(*[F.nullif(F.nullif(F.try_element_at(F.col("m"), F.lit(n)), F.lit("")), F.lit("0"))
                          for n in ("number", "row_number", "row", "line")])
    num = F.trim(stated).try_cast("int")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    said = F.lower(F.try_element_at(F.col("m"), F.lit("has_signature")))
    return rows.select(
        "doc_id", "page",
        F.when(num.between(1, 8), F.col("_start") + num - 1).otherwise(F.col("_start") + kept).alias("line_number"),
        "raw_name", F.concat_ws(", ", filled("address"), filled("city"), filled("zip")).alias("raw_address"),
        F.lit("").alias("raw_date"), F.coalesce(~said.isin("false", "0", ""), F.lit(True)).alias("signature_present"),
        F.coalesce(F.try_element_at(F.col("m"), F.lit("confidence")).try_cast("double"), F.lit(1.0)).alias("ocr_confidence"))


def parse_days(requests: DataFrame, column: str = "preferred_days") -> DataFrame:
    """JSON day lists as arrays, empty when they cannot be read."""
    from ..functions.values import json_list_or_empty
    return requests.withColumn(column, json_list_or_empty(F.col(column)))


def page_fill(rows: DataFrame, upto: int = 7) -> DataFrame:
    """Number rows of a packet in order and add blank rows up to ``upto``."""
    from pyspark.sql import Window
    w = Window.partitionBy("packet_id").orderBy("line_no")
    numbered = rows.withColumn("line_no", F.row_number().over(w).cast("int"))
    have = numbered.groupBy("packet_id").agg(F.max("line_no").alias("n")).where(F.col("n") < upto)
    extra = have.select("packet_id", F.explode(F.sequence(F.col("n") + 1, F.lit(upto))).alias("line_no"))
    types = dict(numbered.dtypes)
    blanks = {c: (F.lit("blank") if c == "row_status" else F.lit(False) if types[c] == "boolean"
                  else F.lit("") if types[c] == "string" else F.lit(None)).cast(types[c])
              for c in numbered.columns if c not in ("packet_id", "line_no")}
    return numbered.unionByName(extra.withColumns(blanks))


def status_domain(c: Column) -> Column:
    return c.isin("approved", "review", "rejected", "duplicate")
