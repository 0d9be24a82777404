"""Cleaning and splitting of names, streets and labels, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name suffixes dropped before comparison.
NAME_SUFFIX = r"(?iuU)\b(jr\.?|sr\.?|ii|iii|iv|esq\.?|phd|md|dds)\b"

# Street type -> short form.
STREET_SHORT = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr",
    "road": "rd", "lane": "ln", "court": "ct", "place": "pl",
    "circle": "cir", "terrace": "ter", "way": "way",
}

# Short form -> long form, used before sequence comparison.
STREET_LONG = {
    "ST": "STREET", "AVE": "AVENUE", "BLVD": "BOULEVARD", "DR": "DRIVE", "RD": "ROAD",
    "LN": "LANE", "CT": "COURT", "PL": "PLACE", "WAY": "WAY",
}

# Upper-case address words -> abbreviations on field pages.
FIELD_ABBREVIATIONS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD",
    "LANE": "LN", "COURT": "CT", "PLACE": "PL", "CIRCLE": "CIR", "HIGHWAY": "HWY",
    "APARTMENT": "APT", "SUITE": "STE", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
# Address words that keep their upper case.
FIELD_KEEP_UPPER = [
    "ST", "AVE", "BLVD", "DR", "RD", "LN", "CT", "PL", "CIR", "HWY", "APT", "STE",
    "N", "S", "E", "W", "NE", "NW", "SE", "SW",
]

# Words that mark preamble text rather than a signer's entry.
HEADER_WORDS = (
    "petition initiative county election circulator registered voter secretary measure "
    "ordinance statute section paragraph fiscal impact sponsor assembly senate district "
    "government pursuant hereby whereas certify circulated declaration proponent "
    "signatures qualified"
).split()
MAX_FIELD_CHARS = 60

# Printed form labels.
PRINTED_LABELS = (
    "print name residence address only city state zip date signature res addr county ca "
    "page circulator declaration circulated circulating circulation"
).split()
FORM_LABEL_TOKENS = "print name signature address residence only city zip state date".split()


# The characters that (?U)\\s matches.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def or_else(c: Column, fallback: Column) -> Column:
    """``fallback`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def words(c: Column) -> Column:
    """White-space separated tokens; an empty array for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def join_nonempty(sep: str, *cols: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in cols])


class _Folded(dict):
    """What each character folds to, worked out once; only a real comma stays one."""

    def __missing__(self, code: int) -> str:
        parts = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        self[code] = parts if code == ord(",") else parts.replace(",", " ")
        return self[code]


_folded = _Folded()


@F.pandas_udf(T.StringType())
def _fold_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.translate(_folded))


def fold(c: Column) -> Column:
    """Text with accents dropped and compatibility forms spelled out.

    ASCII text (almost all of it) stays in the JVM; only other rows carry a value
    through the Arrow UDF, which alone can do full compatibility decomposition.
    """
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, c).otherwise(_fold_unicode(F.when(~ascii_only, c)))


def with_folded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append folded copies of text columns (new name -> source) with one UDF pass for all."""
    sep = "\x1f"
    packed = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in columns.values()])
    df = df.withColumn("_packed", packed)
    df = df.withColumn("_packed", _fold_unicode(F.when(F.col("_packed").rlike(r"[^\x00-\x7F]"), F.col("_packed"))))
    df = df.withColumn("_packed", F.split("_packed", sep))
    df = df.withColumns({new: F.when(F.col("_packed").isNull(), F.coalesce(F.col(old), F.lit(""))).otherwise(F.col("_packed")[i])
                         for i, (new, old) in enumerate(columns.items())})
    return df.drop("_packed")


def plain(c: Column) -> Column:
    """Lower-case words of [a-z0-9]; everything else becomes a blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def clean(c: Column) -> Column:
    return plain(fold(c))


def with_split_name(df: DataFrame, raw: str) -> DataFrame:
    """Append first_name and last_name read from folded text ``raw``.

    'Last, First' or 'First .. Last'; a single word is a last name.
    """
    df = df.withColumn("_nm", strip(F.regexp_replace(F.col(raw), NAME_SUFFIX, "")))
    df = df.withColumn("_nm", F.regexp_replace("_nm", r"(?U)^\d+\s+", ""))
    df = df.withColumn("_cut", F.instr("_nm", ","))
    comma = F.col("_cut") > 0
    df = df.withColumns({
        "_head": plain(F.when(comma, F.substr(F.col("_nm"), F.lit(1), F.col("_cut") - 1)).otherwise(F.col("_nm"))),
        "_tail": plain(F.when(comma, F.substr(F.col("_nm"), F.col("_cut") + 1)).otherwise(""))})
    two = F.contains(F.col("_head"), F.lit(" "))
    return df.withColumns({
        "first_name": F.when(comma, F.col("_tail")).when(two, F.substring_index("_head", " ", 1)).otherwise(""),
        "last_name": F.when(comma, F.col("_head")).when(two, F.substring_index("_head", " ", -1))
        .otherwise(F.col("_head"))}).drop("_nm", "_cut", "_head", "_tail")


def map_words(c: Column, table: dict[str, str]) -> Column:
    """Replace a whole value by its entry in ``table``."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, c), c)


def short_street_type(c: Column) -> Column:
    return map_words(c, STREET_SHORT)


def roll_search_key(last: Column, first: Column, street: Column) -> Column:
    """'last first' and the first four words of the street, lower case only."""
    st = strip(F.lower(street))
    toks = words(st)
    short = F.when(F.size(toks) > 4, F.array_join(F.slice(toks, 1, 4), " ")).otherwise(st)
    return join_nonempty(" ", strip(F.lower(last)), strip(F.lower(first)), short)


def exact_key(last: Column, first: Column, street: Column, city: Column, zip_code: Column) -> Column:
    """name|street|city|zip, or '' when name or street is missing."""
    name = F.regexp_replace(F.lower(F.concat_ws("|", last, first)), r"^\|+|\|+$", "")
    st = strip(F.regexp_replace(F.lower(street), r"(?U)\W+", " "))
    ct = strip(F.regexp_replace(F.lower(city), r"(?U)\W+", " "))
    return F.when((name == "") | (st == ""), F.lit("")).otherwise(
        F.concat_ws("|", name, st, ct, strip(zip_code)))


def house_number(address: Column) -> Column:
    """Leading house number as a whole number of up to 38 digits; null when there is none."""
    return F.regexp_extract(address, r"^\s*(\d+)", 1).try_cast("decimal(38,0)")


def street_without_number(address: Column) -> Column:
    return strip(F.lower(F.regexp_replace(address, r"(?U)^\s*\d+\s*", "")))


def squeeze_date(raw: Column) -> Column:
    return F.regexp_replace(F.lower(strip(raw)), r"(?U)[\s\-/.]", "")


def expand_streets(c: Column) -> Column:
    """Upper case, punctuation to blanks, street types spelled out."""
    s = F.regexp_replace(strip(F.upper(c)), r"(?U)[^\w\s]", " ")
    for short, long in STREET_LONG.items():
        if short != long:
            s = F.regexp_replace(s, rf"(?U)\b{short}\b", long)
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def with_split_address(df: DataFrame, full: Column, street: str, city: str, zip_code: str) -> DataFrame:
    """Append street, city and zip of 'street, city, zip'; the zip only as five digits.

    Small projections, so that the parts are cut once a row.
    """
    parts, n = F.col("_parts"), F.size("_parts")
    df = df.withColumn("_parts", F.filter(F.transform(F.split(F.coalesce(full, F.lit("")), ","), strip), lambda p: p != ""))
    df = df.withColumn("_last", F.when(n > 0, F.element_at(parts, -1)).otherwise(""))
    df = df.withColumn(zip_code, F.when(F.col("_last").rlike(r"^\d{5}$"), F.col("_last")).otherwise(""))
    df = df.withColumn("_parts", F.when(F.col(zip_code) != "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts))
    df = df.withColumns({city: F.when(n >= 2, F.element_at(parts, -1)).otherwise(""),
                         street: F.array_join(F.when(n >= 2, F.slice(parts, F.lit(1), n - 1)).otherwise(parts), ", ")})
    return df.drop("_parts", "_last")


def valid_zip5(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{5}$"), F.lit(False))


# ── field-page normalizers ───────────────────────────────────────────────────

def _printable(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\p{C}", ""), r"(?U)\s+", " "))


def _title(c: Column) -> Column:
    """Capital at the start of each run of letters, the rest lower case."""
    lower = F.lower(c)
    pieces = F.regexp_extract_all(lower, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def field_name(raw: Column) -> Column:
    s = F.regexp_replace(F.upper(_printable(raw)), r"(?U)[^A-Z\s'\-\.]", "")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def field_address(raw: Column) -> Column:
    s = F.upper(_printable(raw))
    for word, short in FIELD_ABBREVIATIONS.items():
        s = F.regexp_replace(s, rf"(?U)\b{word}\b", short)
    return F.array_join(
        F.transform(words(s), lambda w: F.when(w.isin(FIELD_KEEP_UPPER), w).otherwise(_title(w))), " ")


def field_city(raw: Column) -> Column:
    return _title(strip(F.regexp_replace(_printable(raw), r"(?U)[^A-Za-z\s\-]", "")))


def field_zip(raw: Column) -> Column:
    """struct(zip, valid): cleaned zip or zip+4, else the first five digits, else the raw text."""
    digits = F.regexp_replace(strip(raw), r"[^\d\-]", "")
    found = F.regexp_extract(raw, r"(\d{5})", 1)
    whole = digits.rlike(r"^\d{5}(-\d{4})?$")
    return F.struct(
        F.when(whole, digits).when(found != "", found).otherwise(strip(raw)).alias("zip"),
        (whole | (found != "")).alias("valid"))


# ── form labels and noise ────────────────────────────────────────────────────

def is_header_noise(c: Column) -> Column:
    return (F.length(c) > MAX_FIELD_CHARS) | c.rlike(rf"(?iuU)\b({'|'.join(HEADER_WORDS)})\b")


def is_printed_label(c: Column) -> Column:
    core = F.regexp_replace(c, r"^[:.,_\- ]+|[:.,_\- ]+$", "")
    return ((core == "") | c.rlike(r"^[:\-_.,;()/|]{1,3}$")
            | core.rlike(rf"(?i)^({'|'.join(PRINTED_LABELS)})$"))


def strip_row_number(c: Column) -> Column:
    """Drop a leading row digit 1-8, also when it is glued to a word."""
    out = F.regexp_replace(c, r"(?U)^\s*[1-8](?:[\s.):]+|(?=[A-Za-z]))", "")
    return F.regexp_replace(out, r"(?U)^\s+", "")


def strip_form_labels(c: Column) -> Column:
    s = F.regexp_replace(c, rf"(?iuU)\b({'|'.join(FORM_LABEL_TOKENS)})\b", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.regexp_replace(s, r"^[ :.,\-_]+|[ :.,\-_]+$", "")


def level_to_confidence(level: Column) -> Column:
    # Level -> number.
    return (F.when(level == "high", 90.0).when(level == "medium", 65.0)
            .when(level == "low", 35.0).otherwise(0.0))


def confidence_to_level(conf: Column) -> Column:
    # Lower bounds of the levels.
    return (F.when(conf.isNull(), "none").when(conf >= 0.80, "high")
            .when(conf >= 0.50, "medium").otherwise("low"))


def unit_confidence(c: Column) -> Column:
    """Confidence on 0..1: values above 1 are taken as per cent; missing counts as 1."""
    v = F.coalesce(c.cast("double"), F.lit(1.0))
    return F.when(v > 1, v / 100).otherwise(v)


def money(cents: Column) -> Column:
    return F.format_string("$%.2f", cents.cast("double") / 100)


def county_flag(county: Column) -> Column:
    return F.concat(F.lit("city_not_in_"), F.replace(F.lower(county), F.lit(" "), F.lit("_")), F.lit("_county"))


def role_label(role: Column) -> Column:
    # Role -> label shown.
    known = {"field_manager": "Field Manager", "worker": "Worker",
             "petitioner": "Petitioner", "office_worker": "Staff"}
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, role), _title(role))
