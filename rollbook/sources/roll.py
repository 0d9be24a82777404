"""Reading registries: CSV files and text pasted into a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.workforce import global_rank

REQUIRED = ["voter_id", "last_name", "first_name", "street_address"]
# Cells read as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Words that make the first pasted line a header, and the column aliases.
HEADER_WORDS = "name|first|last|address|city|zip"
ALIASES = {"first": ["first name", "firstname", "first"], "last": ["last name", "lastname", "last"],
           "full": ["name", "full name"], "address": ["address", "residence address", "street"],
           "city": ["city"], "zip": ["zip", "zip code", "zipcode"]}


def check_columns(df: DataFrame) -> DataFrame:
    """Headers trimmed and lower-cased; an error names the required columns that lack."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = sorted(set(REQUIRED) - set(out.columns))
    if missing:
        raise ValueError(f"registry lacks columns {missing}; found {out.columns}")
    return out


def read_roll(spark: SparkSession, path: str, with_position: bool = True) -> DataFrame:
    """Registry CSV as strings, blanks for missing cells, with roll_pos in file order."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    names = raw.columns
    if with_position:
        raw = raw.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_i"))
    checked = check_columns(raw.select(*[F.col(f"`{c}`") for c in names])).columns
    fill = lambda c: F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(MISSING), "").otherwise(F.col(f"`{c}`"))
    out = raw.select(*[fill(c).alias(n) for c, n in zip(names, checked)], *(["_f", "_b", "_i"] if with_position else []))
    if with_position:
        out = global_rank(out, ["_f", "_b", "_i"], "roll_pos").drop("_f", "_b", "_i")
    return out


def preview_roll(roll: DataFrame, n: int = 5) -> DataFrame:
    """First rows of a checked registry."""
    return check_columns(roll).limit(n)


def parse_pasted_roll(texts: DataFrame, key: str = "packet_id", text: str = "voter_roll_text") -> DataFrame:
    """(key, pos, name, address, zip) of every entry in pasted registry text.

    Cells are split on tab or comma, without quoting. With a header line columns are
    found by alias; without one, five cells are first, last, address, city, zip, three
    are name, address, zip and two are name, address.
    """
    nonblank = lambda l: strip(l) != ""
    lines = F.filter(F.split(strip(F.col(text)), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), nonblank)
    df = texts.select(key, lines.alias("_lines")).where(F.size("_lines") > 0)
    cells = lambda l: F.transform(F.split(l, r"[\t,]"), strip)
    df = df.withColumn("_headed", F.lower(F.col("_lines")[0]).rlike(HEADER_WORDS))
    df = df.withColumn("_head", F.when(F.col("_headed"), F.reverse(F.transform(cells(F.col("_lines")[0]), F.lower))))
    df = df.select(key, "_headed", "_head", F.posexplode(F.when(
        F.col("_headed"), F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))).otherwise(F.col("_lines"))).alias("pos", "_line"))
    df = df.withColumn("_c", cells(F.col("_line"))).where(F.exists("_c", lambda c: c != ""))

    def at(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_c"), i), F.lit(""))

    def named(kind: str, default: Column) -> Column:
        # Position counted from the last header of that name; null when there is none.
        found = [F.when(F.array_contains("_head", n), at(F.size("_head") - F.array_position(F.col("_head"), F.lit(n)).cast("int")))
                 for n in ALIASES[kind]]
        return F.coalesce(*found, default)

    none, n = F.lit(""), F.size("_c")
    pair = strip(F.concat(named("first", none), F.lit(" "), named("last", none)))
    c = lambda i: at(F.lit(i))
    headed = F.struct(named("full", pair).alias("name"), named("address", none).alias("address"),
                      named("city", none).alias("city"), named("zip", none).alias("zip"))
    plain = (F.when(n >= 5, F.struct(strip(F.concat(c(0), F.lit(" "), c(1))).alias("name"), c(2).alias("address"),
                                     c(3).alias("city"), c(4).alias("zip")))
             .when(n >= 3, F.struct(c(0).alias("name"), c(1).alias("address"), none.alias("city"), c(2).alias("zip")))
             .when(n >= 2, F.struct(c(0).alias("name"), c(1).alias("address"), none.alias("city"), none.alias("zip"))))
    df = df.withColumn("_v", F.when(F.col("_headed"), headed).otherwise(plain)).where("_v is not null")
    return df.select(key, "pos", F.col("_v.name").alias("name"),
                     strip(F.concat("_v.address", F.lit(" "), "_v.city")).alias("address"),
                     F.substring(F.regexp_replace("_v.zip", r"(?U)\D", ""), 1, 5).alias("zip"))
