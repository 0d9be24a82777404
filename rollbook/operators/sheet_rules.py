"""Rules that look for one hand filling in many lines of a sheet.

Flags come as one row each: (project_id, line_number, code, partner_line, shared,
n_lines). Rules about a pair or a run name the first partner; rules about a whole
group (same city, same date) name the shared value instead, and the lines concerned
are the rows with the same (project_id, code, shared) — listing them on every line
would be quadratic in the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from .similar import DIRECT_TEXTS, distinct_texts, first_partner

# Flag codes and thresholds.
BLANK_LINE, NO_SIGNATURE, SAME_CITY = "blank_line", "no_signature", "same_city"
NEARBY_ADDRESS, CONSECUTIVE = "nearby_address", "consecutive_addresses"
DUPLICATE_NAME, DUPLICATE_ADDRESS = "duplicate_name", "duplicate_address"
SAME_DATE, SAME_HANDWRITING = "same_date", "same_handwriting"
NAME_SIMILARITY, ADDRESS_SIMILARITY = 92, 88
NEARBY_GAP, RUN_LENGTH, DOMINANT_SHARE, MIN_LINES = 10, 4, 0.70, 4
HANDWRITING_SIMILARITY = 0.97

KEY = ["project_id", "line_number"]


def _flags(df: DataFrame, code: str, partner: Column | None = None, shared: Column | None = None,
           n_lines: Column | None = None) -> DataFrame:
    return df.select(
        *KEY, F.lit(code).alias("code"),
        (partner if partner is not None else F.lit(None)).cast("int").alias("partner_line"),
        (shared if shared is not None else F.lit(None)).cast("string").alias("shared"),
        (n_lines if n_lines is not None else F.lit(None)).cast("bigint").alias("n_lines"))


def is_blank_line() -> Column:
    return tx.blank(F.col("raw_name")) & tx.blank(F.col("raw_address"))


def blank_lines(lines: DataFrame) -> DataFrame:
    return _flags(lines.where(is_blank_line()), BLANK_LINE)


def unsigned_lines(lines: DataFrame) -> DataFrame:
    return _flags(lines.where(~is_blank_line() & ~F.col("signature_present")), NO_SIGNATURE)


def dominant_value(lines: DataFrame, value: Column, keys: list[str], min_lines: int = MIN_LINES,
                   share: float = DOMINANT_SHARE, count_blank: bool = True) -> DataFrame:
    """(keys, shared, top, total) where one non-blank value holds ``share`` of the lines.

    With ``count_blank`` lines without a value count in the total.
    """
    per = lines.withColumn("shared", value)
    if not count_blank:
        per = per.where("shared <> ''")
    counted = per.groupBy(*keys, "shared").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("shared") != "", F.struct(F.col("n").alias("top"), F.col("shared")))).alias("b"))
    return (best.select(*keys, "total", "b.*").where((F.col("total") >= min_lines) & F.col("top").isNotNull())
            .where(F.col("top") / F.col("total") >= share))


def same_city(lines: DataFrame, share: float = DOMINANT_SHARE, min_lines: int = MIN_LINES) -> DataFrame:
    """Lines in the city that holds most filled lines of the sheet."""
    filled = lines.where(~is_blank_line()).withColumn("_city", F.lower(tx.strip(F.coalesce("city", F.lit("")))))
    top = dominant_value(filled, F.col("_city"), ["project_id"], min_lines, share)
    hit = filled.join(top.withColumnRenamed("shared", "_city"), ["project_id", "_city"])
    return _flags(hit, SAME_CITY, shared=F.col("_city"), n_lines=F.col("top"))


def same_date(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Dated lines of sheets on which every date is the same."""
    dated = lines.where(~is_blank_line() & ~tx.blank(F.col("raw_date"))).withColumn(
        "_date", tx.squeeze_date(F.col("raw_date")))
    one = dated.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("_date").alias("lo"), F.max("_date").alias("hi"))
    one = one.where((F.col("n") >= min_lines) & (F.col("lo") == F.col("hi")) & (F.col("lo") != ""))
    hit = dated.join(one.select("project_id", "n"), "project_id")
    return _flags(hit, SAME_DATE, shared=F.col("_date"), n_lines=F.col("n"))


def address_rules(lines: DataFrame, gap: int = NEARBY_GAP) -> DataFrame:
    """nearby_address and consecutive_addresses.

    Works on one row per house number of a street with its lines, so a window never holds
    more than the numbers of one street, and lines are shuffled once and not joined back. Neighbours: the lowest number within ``gap`` below,
    else the next one above. Runs: four numbers in steps of one, where the two inner
    numbers occur once (a repeated number breaks the run, as sorted lines would).
    """
    numbered = (
        lines.where(~is_blank_line())
        .select(*KEY, tx.house_number(F.col("raw_address")).alias("number"),
                tx.street_without_number(F.col("raw_address")).alias("road"))
        .where("number is not null and road <> ''"))
    place = ["project_id", "road"]
    numbers = numbered.repartition(*place).groupBy(*place, "number").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first"), F.max("line_number").alias("last"),
        F.collect_list("line_number").alias("line_numbers"))
    w = Window.partitionBy(*place).orderBy("number")
    seen = numbers.withColumns({
        "below": F.first("first").over(w.rangeBetween(-gap, -1)),
        "above": F.first("first").over(w.rangeBetween(1, gap)),
        **{f"n{k}": F.lead("number", k).over(w) for k in (1, 2, 3)},
        **{f"c{k}": F.lead("n", k).over(w) for k in (1, 2)},
        **{f"f{k}": F.lead("first", k).over(w) for k in (1, 2, 3)}})
    close = seen.where("below is not null or above is not null").select(
        "project_id", F.explode("line_numbers").alias("line_number"), F.coalesce("below", "above").alias("partner"))
    nearby = _flags(close, NEARBY_ADDRESS, partner=F.col("partner"))

    runs = seen.where("n1 = number + 1 and n2 = number + 2 and n3 = number + 3 and c1 = 1 and c2 = 1")
    members = F.array("last", "f1", "f2", "f3")
    flagged = runs.select("project_id", "number", members.alias("run"), F.explode(members).alias("line_number"))
    first_run = flagged.groupBy(*KEY).agg(F.min_by("run", "number").alias("run"))
    others = F.array_join(F.transform(F.filter("run", lambda x: x != F.col("line_number")),
                                      lambda x: x.cast("string")), ",")
    consecutive = _flags(first_run, CONSECUTIVE, shared=others, n_lines=F.lit(RUN_LENGTH))
    return nearby.unionByName(consecutive)


def duplicate_names(lines: DataFrame, threshold: int = NAME_SIMILARITY, direct: int = DIRECT_TEXTS) -> DataFrame:
    named = lines.select(*KEY, F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("who"))
    return _flags(first_partner(named, *KEY, "who", threshold, direct), DUPLICATE_NAME, F.col("partner"))


def duplicate_addresses(lines: DataFrame, threshold: int = ADDRESS_SIMILARITY, direct: int = DIRECT_TEXTS) -> DataFrame:
    placed = lines.select(*KEY, tx.strip(F.col("street")).alias("place"))
    return _flags(first_partner(placed, *KEY, "place", threshold, direct), DUPLICATE_ADDRESS, F.col("partner"))


def similar_vectors(vectors: DataFrame, group: str, order: str, vector: str, cutoff: float = HANDWRITING_SIMILARITY,
                    tile: int = 2048) -> DataFrame:
    """(group, order, partner): the first line of the group whose vector is that close.

    Distinct vectors only; a group is split into tiles, one for a normal sheet, and tile
    pairs are compared by matrix products that return close pairs alone: one formula for
    every size.
    """
    rows = vectors.where(F.size(vector) > 0).withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    rows = rows.withColumn("_h", F.sha2(F.to_json(F.struct("_v")), 256))
    known = distinct_texts(rows, group, "_h", order).join(
        rows.groupBy(F.col(group).alias("grp"), F.col("_h").alias("txt")).agg(F.any_value("_v").alias("v")),
        ["grp", "txt"])
    known = cut(known)
    tiles = known.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))

    cells = known.join(tiles, "grp").withColumn(
        "t", F.pmod(F.xxhash64("txt"), F.col("tiles")).cast("int"))
    left = cells.select("grp", "txt", "v", F.col("t").alias("i"), F.explode(F.sequence("t", F.col("tiles") - 1)).alias("j"))
    right = cells.select(F.col("grp").alias("grp2"), F.col("txt").alias("txt2"), F.col("v").alias("v2"),
                         F.col("t").alias("j2"), F.explode(F.sequence(F.lit(0), "t")).alias("i2"))

    def close(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"grp": [], "a": [], "b": []})
        x, y = np.vstack(a["v"].to_numpy()), np.vstack(b["v2"].to_numpy())
        sim = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :] + 1e-9)
        i, j = np.nonzero(sim >= cutoff)
        p, q = a["txt"].to_numpy()[i], b["txt2"].to_numpy()[j]
        lo, hi = np.where(p < q, p, q), np.where(p < q, q, p)
        out = pd.DataFrame({"grp": a["grp"].iloc[0], "a": lo, "b": hi})
        return out[out["a"] != out["b"]].drop_duplicates()

    big = left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp2", "i2", "j2")).applyInPandas(
        close, f"grp {dict(known.dtypes)['grp']}, a string, b string").distinct()
    both = F.array(F.struct(F.col("a").alias("txt"), F.col("b").alias("other")),
                   F.struct(F.col("b").alias("txt"), F.col("a").alias("other")))
    near = big.select("grp", F.inline(both)).join(
        known.select("grp", F.col("txt").alias("other"), F.col("first").alias("of")), ["grp", "other"])
    near = near.groupBy("grp", "txt").agg(F.min("of").alias("of"))
    found = known.drop("v").join(near, ["grp", "txt"], "left").select(
        F.col("grp").alias(group), F.col("txt").alias("_h"), "first", "second", "of")
    own = F.when(F.col(order) == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return (rows.select(group, order, "_h").join(found, [group, "_h"]).withColumn("partner", F.least(own, F.col("of")))
            .where("partner is not null").select(group, order, "partner"))


def stated_pairs(lines: DataFrame) -> DataFrame:
    """Distinct (project_id, line_number, partner) from the explicit same-writer lists, both ways."""
    said = lines.where(F.size("same_handwriting_as") > 0).select(*KEY, F.explode("same_handwriting_as").alias("partner"))
    back = said.select("project_id", F.col("partner").alias("line_number"), F.col("line_number").alias("partner"))
    return said.unionByName(back).distinct()


def same_handwriting(lines: DataFrame, cutoff: float = HANDWRITING_SIMILARITY, tile: int = 2048) -> DataFrame:
    """Lines by one writer: explicit pairs where a sheet has any, else close vectors."""
    pairs = stated_pairs(lines)
    known = pairs.join(lines.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("partner").alias("partner"))
    silent = lines.join(pairs.select("project_id").distinct(), "project_id", "left_anti")
    close = similar_vectors(silent, "project_id", "line_number", "handwriting_vector", cutoff, tile)
    return _flags(known.unionByName(close), SAME_HANDWRITING, F.col("partner"))


def scan_sheets(lines: DataFrame, direct: int = DIRECT_TEXTS) -> DataFrame:
    """All rules over normalized lines; handwriting only when its columns are there."""
    out = blank_lines(lines)
    parts = [unsigned_lines(lines), same_city(lines), address_rules(lines), duplicate_names(lines, direct=direct),
             duplicate_addresses(lines, direct=direct), same_date(lines)]
    if {"same_handwriting_as", "handwriting_vector"} <= set(lines.columns):
        parts.append(same_handwriting(lines))
    for p in parts:
        out = out.unionByName(p)
    return out


def scan_summary(lines: DataFrame, flags: DataFrame) -> DataFrame:
    """Per sheet: total, blank, filled, suspicious and clean lines, and flag counts as a map."""
    total = lines.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_lines"))
    codes = flags.where(F.col("code") != BLANK_LINE).groupBy("project_id", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = codes.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("flag_counts"))
    per_line = flags.groupBy(*KEY).agg(
        F.max((F.col("code") == BLANK_LINE).cast("int")).alias("blank"),
        F.max((F.col("code") != BLANK_LINE).cast("int")).alias("sus"))
    tally = per_line.groupBy("project_id").agg(F.sum("blank").alias("blank_lines"), F.sum("sus").alias("suspicious_lines"))
    out = total.join(tally, "project_id", "left").join(counts, "project_id", "left").na.fill(0)
    return out.withColumn("filled_lines", F.col("total_lines") - F.col("blank_lines")).withColumn(
        "clean_lines", F.col("filled_lines") - F.col("suspicious_lines"))
