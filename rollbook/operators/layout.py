"""Word boxes to sheet rows.

Words: doc_id, seq, text, lft, top, width, height, conf. Pages: doc_id, page_width,
page_height. Everything that must run in order over a page runs over its distinct
``top`` values, which the page's height bounds, never over its words; words are only
gathered inside one visual row. Words are shuffled once, by page: what a page's words
need to know lies in one row a page, and a word finds its row or block there by its height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..session import cut

PAGE = ["doc_id"]
# Merge distances and windows, in pixels and rows.
ROW_MERGE, WIDE_MERGE, HEADER_MERGE, CONTINUATION = 20, 40, 150, 250
FUSE_GAP, ROW_TOLERANCE, BLOCK_ABOVE, BLOCK_BELOW, DENSE_WORDS = 15, 35, 70, 200, 20
HEADER_BIN, ANCHOR_BAND = 60, 80
CLUSTER_GAP = 8
SHELF = 100
# Column bands when no header is read, and header words of each column.
DEFAULT_BANDS = {"name": (0.00, 0.38), "address": (0.38, 0.74), "date": (0.74, 0.88), "sig": (0.88, 1.00)}
BAND_ALIASES = {"name": ["name", "full name", "print name", "signer"],
                "address": ["address", "residence address", "addr", "street"],
                "date": ["date", "signed", "date signed"], "sig": ["signature", "sig", "sign here"]}
# Printed column headers and the default start of each column.
COLUMN_HEADERS = {"sig": r"^signature$", "name": r"^(print|name)$", "addr": r"^(residence|address)$",
                  "city": r"^city$", "zip": r"^zip$", "date": r"^(date|signed)$"}
COLUMN_STARTS = {"sig": 0.03, "name": 0.15, "addr": 0.38, "city": 0.63, "zip": 0.78, "date": 0.88}
# How row numbers and zips are printed.
ROW_NUMBER = r"^[1-8][.):]*$"
ZIP = r"^\d{5}(-\d{4})?$"


def _is(pattern: str) -> Column:
    return F.col("text").rlike("(?i)" + pattern)


def boxes(words: DataFrame) -> DataFrame:
    """Append right, bottom, cx, cy."""
    half = lambda c: F.floor(F.col(c) / 2)
    return words.withColumns({"right": F.col("lft") + F.col("width"), "bottom": F.col("top") + F.col("height"),
                              "cx": F.col("lft") + half("width"), "cy": F.col("top") + half("height")})


def join_words(found: Column, fuse: int | None = FUSE_GAP) -> Column:
    """Text of an array of (lft, top, seq, right, text), left to right.

    Words closer than ``fuse`` pixels are joined without a blank; None always blanks.
    """
    def step(acc, w):
        glue = F.lit(" ") if fuse is None else F.when(w["lft"] - acc["right"] <= fuse, "").otherwise(" ")
        return F.struct(F.concat(acc["text"], F.when(acc["right"].isNull(), "").otherwise(glue), w["text"]).alias("text"),
                        w["right"].cast("bigint").alias("right"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("bigint").alias("right"))
    return F.aggregate(F.sort_array(found), start, step, lambda acc: F.trim(acc["text"]))


def _pick(cond: Column) -> Column:
    """Words of the group that meet ``cond``, ready for join_words."""
    return F.collect_list(F.when(cond, F.struct("lft", "top", "seq", "right", "text")))


def _first(cond: Column, *cols: str, order: tuple[str, ...] = ("top", "seq")) -> Column:
    return F.min_by(F.when(cond, F.struct(*cols)), F.when(cond, F.struct(*order)))


def _block():
    return Window.partitionBy(*PAGE, "idx")


def on_pages(words: DataFrame, facts: DataFrame) -> DataFrame:
    """Words with the one row of their page.

    The facts are hashed: words are neither sorted nor, once they lie by page, shuffled again,
    and groups and windows inside a page stay where they are.
    """
    return words.join(facts.hint("shuffle_hash"), PAGE)


def _cells(places: Column, width: int) -> Column:
    """Per cell of ``width`` pixels, from the first of the sorted ``places`` to the last: how many places lie in earlier cells."""
    cell = lambda p: F.floor(p / width)
    return F.flatten(F.transform(places, lambda p, i: F.array_repeat(
        i, (cell(p) - F.coalesce(cell(F.get(places, i - 1)), cell(p) - 1)).cast("int"))))


def _earlier(cells: Column, places: Column, cell: Column, width: int) -> Column:
    """How many of ``places`` lie in cells before ``cell``; a look-up, whatever the page holds."""
    at = (cell - F.floor(F.get(places, F.lit(0)) / width)).cast("int")
    return F.when(at < 0, 0).otherwise(F.coalesce(F.get(cells, at), F.size(places)))


# ── rows ─────────────────────────────────────────────────────────────────────

def _starts(tops: Column, merge: int) -> Column:
    """First tops of the rows: a row starts where a top is more than ``merge`` below its first top."""
    fold = lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > merge),
                                 F.array_append(acc, t)).otherwise(acc)
    return F.aggregate(tops, F.expr("array()").cast("array<bigint>"), fold)


def _row_at(top: Column, merge: int) -> Column:
    """Row of a top by the page's ``starts`` and ``cells``; a cell of ``merge`` pixels holds one start at most."""
    n = _earlier(F.col("cells"), F.col("starts"), F.floor(top / merge), merge)
    return (n + F.when(F.get("starts", n) <= top, 1).otherwise(0)).cast("bigint")


def _tops(words: DataFrame, *marks: Column) -> DataFrame:
    """(page, tops): the sorted distinct tops of a page, as structs with ``marks`` aggregated over their words."""
    src = words.withColumn("top", F.col("top").cast("bigint"))
    one = src.groupBy(*PAGE, "top").agg(*marks) if marks else src.select(*PAGE, "top").distinct()
    rest = [c for c in one.columns if c not in PAGE]
    return one.where("top is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("tops"))


def cluster_rows(words: DataFrame, merge: int = ROW_MERGE) -> DataFrame:
    """Append row (1..n per page, top to bottom)."""
    facts = _tops(words).select(*PAGE, _starts(F.col("tops.top"), merge).alias("starts"))
    facts = facts.withColumn("cells", _cells(F.col("starts"), merge))
    src = words.withColumn("top", F.col("top").cast("bigint")).where("top is not null")
    return on_pages(src, facts).withColumn("row", _row_at(F.col("top"), merge)).drop("starts", "cells")


def cluster_values(values: DataFrame, keys: list[str], value: str, gap: int = CLUSTER_GAP) -> DataFrame:
    """(keys, cluster, centre, n): runs of sorted values no more than ``gap`` apart."""
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy(value)
    cut = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1))
    runs = counted.withColumn("_c", cut).withColumn("cluster", F.sum("_c").over(w))
    return runs.groupBy(*keys, "cluster").agg(
        F.floor(F.sum(F.col(value) * F.col("k")) / F.sum("k")).cast("bigint").alias("centre"), F.sum("k").alias("n"))


def _with_signers(pages: DataFrame, merge: int, reach: int = CONTINUATION) -> DataFrame:
    """Append starts, cells and signers (one a row) to pages with ``tops`` (top, has_number).

    Rows without a row number join the signer above within ``reach``.
    """
    # A row carries its first top and whether any of its tops has a number.
    row = "struct<top:bigint,has_number:boolean>"
    init = F.struct(F.lit(None).cast(row).alias("last"), F.expr("array()").cast(f"array<{row}>").alias("out"))
    done = lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"]))

    def into_rows(acc, t):
        opens = acc["last"].isNull() | (t["top"] - acc["last"]["top"] > merge)
        last = F.struct(F.when(opens, t["top"]).otherwise(acc["last"]["top"]).alias("top"),
                        F.when(opens, t["has_number"]).otherwise(acc["last"]["has_number"] | t["has_number"]).alias("has_number"))
        return F.struct(last.cast(row).alias("last"), F.when(opens, done(acc)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("top"),
                     F.expr("array()").cast("array<bigint>").alias("out"))

    def into_signers(acc, r):
        opens = r["has_number"] | acc["top"].isNull() | (r["top"] - acc["top"] > reach)
        sid = acc["id"] + F.when(opens, 1).otherwise(0).cast("bigint")
        return F.struct(sid.alias("id"), F.when(opens, r["top"]).otherwise(acc["top"]).alias("top"),
                        F.array_append(acc["out"], sid).alias("out"))

    rows = pages.withColumn("rows", F.aggregate("tops", init, into_rows, done)).drop("tops").where(F.size("rows") > 0)
    rows = rows.withColumns({"starts": F.col("rows.top"), "signers": F.aggregate("rows", start, into_signers, lambda a: a["out"])})
    return rows.withColumn("cells", _cells(F.col("starts"), merge)).drop("rows")


# ── grid and labels ──────────────────────────────────────────────────────────

def near_labels(words: DataFrame, a: str, b: str, tolerance: int = 80) -> DataFrame:
    """(page, top): height of the first (a, b) word pair no more than ``tolerance`` apart."""
    spots = lambda p, n: words.where(_is(p)).groupBy(*PAGE, F.col("top").alias(f"top_{n}")).agg(F.min("seq").alias(f"seq_{n}"))
    pairs = spots(a, "a").join(spots(b, "b"), PAGE).where(F.abs(F.col("top_a") - F.col("top_b")) <= tolerance)
    return pairs.groupBy(*PAGE).agg(F.min_by(F.least("top_a", "top_b"), F.struct("seq_a", "seq_b")).alias("top"))


def grid_tops(words: DataFrame) -> DataFrame:
    """(page, grid_top): where the signature grid starts.

    By the words of the instruction line, else the word 'signers', else 44 % of the page.
    """
    pairs = [("^registered$", "^vote$"), ("^signers$", "^registered$"), ("^all$", "^signers$")]
    out = words.groupBy(*PAGE).agg(
        F.min(F.when(_is("^signers$"), F.col("top"))).alias("alone"),
        F.floor(F.max(F.col("top") + F.col("height")) * 0.44).cast("bigint").alias("guess"))
    for i, (a, b) in enumerate(pairs):
        out = out.join(near_labels(words, a, b).withColumnRenamed("top", f"t{i}"), PAGE, "left")
    real = lambda c: F.nullif(F.col(c), F.lit(0))
    return out.select(*PAGE, F.coalesce(real("t0"), real("t1"), "t2", "alone", "guess").alias("grid_top"))


def clip_to_grid(words: DataFrame, pages: DataFrame | None = None, min_share: float = 0.2) -> DataFrame:
    """Words between the grid top and the declaration.

    With ``pages`` a declaration closer to the grid top than ``min_share`` of the page
    height is taken for a heading and ignored.
    """
    stop = words.where(_is("^declaration$")).groupBy(*PAGE).agg(F.min_by("top", "seq").alias("decl_top"))
    edges = grid_tops(words).join(stop, PAGE, "left")
    if pages is not None:
        edges = edges.join(pages.select(*PAGE, "page_height"), PAGE, "left").withColumn("decl_top", F.when(
            F.col("decl_top") - F.col("grid_top") >= F.coalesce("page_height", F.lit(0)) * min_share, F.col("decl_top"))).drop("page_height")
    return (on_pages(words, edges).where(F.col("top") >= F.col("grid_top"))
            .where(F.col("decl_top").isNull() | (F.col("top") < F.col("decl_top"))).drop("grid_top", "decl_top"))


def print_name_anchors(words: DataFrame) -> DataFrame:
    """'Print' words with a 'Name' no more than 40 px off in height and 300 px to the right."""
    names = words.where(_is("^name:?$")).select(*PAGE, F.col("top").alias("n_top"), F.col("lft").alias("n_lft")).distinct()
    step = F.col("n_lft") - F.col("lft")
    prints = words.where(_is("^print$"))
    near = (F.abs(F.col("n_top") - F.col("top")) <= 40) & (step > 0) & (step < 300)
    same = [F.col(c) == F.col(f"n_{c}") for c in PAGE]
    return prints.join(names.withColumnsRenamed({c: f"n_{c}" for c in PAGE}).hint("shuffle_hash"), [*same, near], "left_semi")


def number_anchors(words: DataFrame, band: int = ANCHOR_BAND, numbers: str = "[1-8]") -> DataFrame:
    """Line-number words: those in the x-band that holds most distinct ``numbers`` (at least 3).

    ``nth`` counts the words of one number from the top. Candidates are reduced to
    distinct (x, digit) first, which the page width bounds.
    """
    digits = boxes(words).withColumn("digit", F.regexp_extract("text", rf"^({numbers})\.?$", 1)).where("digit <> ''").select(
        *PAGE, "digit", "seq", "top", "lft", "right", "bottom")
    spots = digits.groupBy(*PAGE, "lft", "digit").agg(F.count(F.lit(1)).alias("k"))
    seen = digits.groupBy(*PAGE, "digit").agg(F.min("seq").alias("digit_at"))
    refs = digits.join(seen.hint("shuffle_hash"), [*PAGE, "digit"]).groupBy(*PAGE, F.col("lft").alias("r_lft"), F.col("right").alias("r_right")).agg(
        F.min(F.struct("digit_at", "seq")).alias("at"))
    counts = (refs.join(spots, PAGE).where(F.col("lft").between(F.col("r_lft") - band, F.col("r_right") + band))
              .groupBy(*PAGE, "r_lft", "r_right", "at").agg(F.countDistinct("digit").alias("n")))
    best = counts.where("n >= 3").groupBy(*PAGE).agg(
        F.min_by(F.struct("r_lft", "r_right"), F.struct(-F.col("n"), "at")).alias("b"), F.max("n").alias("n_digits"))
    inside = on_pages(digits, best).where(F.col("lft").between(F.col("b.r_lft") - band, F.col("b.r_right") + band))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "digit").orderBy("top", "seq"))
    return inside.select(*PAGE, "digit", "n_digits", nth.alias("nth"), "seq", "top", "lft", "right", "bottom")


def column_headers(words: DataFrame, bin_px: int = HEADER_BIN) -> DataFrame:
    """Column starts (sig, name, addr, city, zip, date) and header_y of pages with a header row.

    The 60 px bin with most distinct column words wins when it has at least three.
    """
    field = None
    for f, pat in COLUMN_HEADERS.items():
        field = F.when(_is(pat), f) if field is None else field.when(_is(pat), f)
    hits = words.withColumn("field", field).where("field is not null").withColumn("bin", F.floor(F.col("top") / bin_px))
    votes = hits.groupBy(*PAGE, "bin").agg(F.countDistinct("field").alias("n"), F.min("seq").alias("at")).where("n >= 3")
    best = votes.groupBy(*PAGE).agg(F.min_by("bin", F.struct(-F.col("n"), "at")).alias("bin"))
    firsts = hits.join(best, [*PAGE, "bin"]).groupBy(*PAGE, "field").agg(
        F.min_by(F.struct("lft", (F.col("top") + F.col("height")).alias("bottom")), F.struct("lft", "seq")).alias("w"))
    return firsts.groupBy(*PAGE).agg(
        F.max("w.bottom").alias("header_y"),
        *[F.max(F.when(F.col("field") == f, F.col("w.lft"))).alias(f"x_{f}") for f in COLUMN_HEADERS])


# ── extraction by printed columns ────────────────────────────────────────────

def extract_by_headers(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Signer rows from the printed column headers, or from proportional columns."""
    edge = pages.join(column_headers(words), PAGE, "left")
    start = lambda f: F.when(F.col("header_y").isNotNull() & F.col(f"x_{f}").isNotNull(), F.col(f"x_{f}")).otherwise(
        F.floor(F.col("page_width") * COLUMN_STARTS[f]))
    edge = edge.select(*PAGE, "page_width", F.coalesce("header_y", F.lit(0)).alias("header_y"),
                       *[start(f).alias(f"x_{f}") for f in COLUMN_STARTS])
    below = _tops(words, F.max(_is(ROW_NUMBER)).alias("has_number")).join(edge, PAGE).withColumn(
        "tops", F.filter("tops", lambda t: t["top"] > F.col("header_y") + 5))
    facts = _with_signers(below, HEADER_MERGE)
    src = words.withColumn("top", F.col("top").cast("bigint")).where("top is not null")
    body = boxes(on_pages(src, facts).where(F.col("top") > F.col("header_y") + 5)).withColumns({
        "signer": F.get("signers", (_row_at(F.col("top"), HEADER_MERGE) - 1).cast("int")),
        "label": tx.is_printed_label(F.col("text")), "number": _is(ROW_NUMBER)}).drop("signers", "starts", "cells")
    w = Window.partitionBy(*PAGE, "signer")
    body = body.withColumns({
        "numbered": F.max("number").over(w),
        "city_label": _first(_is(r"^city[:.,]?$"), "lft", "right").over(w),
        "zip_label": _first(_is(r"^(zip|zipcode|zip[-_]?code)[:.,]?$"), "lft", "right").over(w)}).where("numbered")
    x = lambda f: F.col("page_width") if f == "end" else F.col(f"x_{f}")
    band = lambda a, b: (F.col("lft") >= x(a)) & (F.col("lft") < x(b)) & ~F.col("label")
    after = lambda lab, hi: (F.col("lft") > F.col(f"{lab}.right")) & (F.col("lft") < hi) & ~F.col("label") & ~F.col("number")
    has_city, has_zip = F.col("city_label").isNotNull(), F.col("zip_label").isNotNull()
    in_city = F.when(has_city, after("city_label", F.when(has_zip, F.col("zip_label.lft")).otherwise(x("zip")))).otherwise(band("city", "zip"))
    in_zip = F.when(has_zip, after("zip_label", x("date"))).otherwise(band("zip", "date")) & _is(ZIP)
    rows = body.groupBy(*PAGE, "signer").agg(
        _pick(band("name", "addr") & ~F.col("number")).alias("name"), _pick(band("addr", "city")).alias("addr"),
        _pick(in_city).alias("city"), _pick(in_zip).alias("zip"), _pick(band("date", "end")).alias("date"),
        F.max(band("sig", "name") & ~F.col("number")).alias("signature_present"), F.avg("conf").alias("conf"))
    tidy = lambda c: tx.strip_form_labels(join_words(F.col(c)))
    out = rows.select(*PAGE, "signer",
                      tx.strip_form_labels(tx.strip_row_number(join_words(F.col("name")))).alias("raw_name"),
                      tx.join_nonempty(", ", tidy("addr"), tidy("city"), tidy("zip")).alias("raw_address"),
                      tidy("date").alias("raw_date"), "signature_present", vl.round_py(F.col("conf"), 1).alias("ocr_confidence"))
    return _numbered(out.where("raw_name <> '' or raw_address <> ''"), "signer")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy(order)
    return rows.withColumn("line_number", F.row_number().over(w)).drop(order)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each page, for a display of that size; extraction itself never cuts."""
    return rows.where(F.col("line_number") <= n)


# ── extraction by bands ──────────────────────────────────────────────────────

def column_bands(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, field, lo, hi) shares of the page width, from the first row with three header words or more."""
    field = None
    for f, names in BAND_ALIASES.items():
        cond = F.lower("text").isin(names)
        field = F.when(cond, f) if field is None else field.when(cond, f)
    seen = boxes(rows).withColumn("field", field).where("field is not null").groupBy(*PAGE, "row", "field").agg(
        F.min_by("cx", F.struct("top", "seq")).alias("cx"))
    chosen = (seen.groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
              .groupBy(*PAGE).agg(F.min("row").alias("row")))
    w = Window.partitionBy(*PAGE).orderBy("cx", "field")
    mid = lambda other: vl.round_py((F.col("cx") + other) / 2 / F.col("page_width"), 3)
    found = seen.join(chosen, [*PAGE, "row"]).join(pages.select(*PAGE, "page_width"), PAGE).select(
        *PAGE, "field", F.coalesce(mid(F.lag("cx").over(w)), F.lit(0.0)).alias("lo"),
        F.coalesce(mid(F.lead("cx").over(w)), F.lit(1.0)).alias("hi"))
    fixed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                      for f, (lo, hi) in DEFAULT_BANDS.items()])
    plain = pages.join(chosen, PAGE, "left_anti").select(*PAGE, F.inline(fixed))
    return found.unionByName(plain)


def extract_by_bands(words: DataFrame, pages: DataFrame, merge: int = WIDE_MERGE) -> DataFrame:
    """Signer rows by column bands; header rows and rows without name and address are left out."""
    rows = boxes(cluster_rows(words, merge))
    bands = column_bands(rows, pages).groupBy(*PAGE).agg(*[
        F.max(F.when(F.col("field") == f, F.col(b))).alias(f"{f}_{b}") for f in DEFAULT_BANDS for b in ("lo", "hi")])
    src = on_pages(rows, bands.join(pages.select(*PAGE, "page_width"), PAGE))
    edge = lambda f, b: F.floor(F.col(f"{f}_{b}") * F.col("page_width"))
    inside = lambda f: F.coalesce((F.col("cx") >= edge(f, "lo")) & (F.col("cx") < edge(f, "hi")), F.lit(False))
    heads = ["name", "address", "date", "signature", "city", "zip", "state"]
    hits = sum((F.max(F.contains(F.lower("text"), F.lit(h)).cast("int")) for h in heads), F.lit(0))
    out = src.groupBy(*PAGE, "row").agg(
        *[_pick(inside(f)).alias(f) for f in ("name", "address", "date")], F.max(inside("sig")).alias("signature_present"),
        F.avg("conf").alias("conf"), hits.alias("heads"))
    out = out.where("heads < 3").select(
        *PAGE, "row", *[join_words(F.col(f), None).alias(f"raw_{f}") for f in ("name", "address", "date")],
        "signature_present", vl.round_py(F.col("conf"), 1).alias("ocr_confidence"))
    return _numbered(out.where("raw_name <> '' or raw_address <> ''"), "row")


# ── extraction by anchors ────────────────────────────────────────────────────

def blocks(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """Vertical extent of each signer block: to the next anchor, the declaration or 200 px.

    ``anchors``: page, seq, top, lft, right. Appends idx, block_top, block_bottom.
    """
    stop = words.where(_is("^declaration$")).groupBy(*PAGE).agg(F.min_by("top", "seq").alias("decl"))
    w = Window.partitionBy(*PAGE).orderBy("top", "seq")
    out = anchors.withColumns({"idx": F.row_number().over(w), "next_top": F.lead("top").over(w)}).join(stop, PAGE, "left")
    reach = F.col("top") + BLOCK_BELOW
    limit = F.least(F.coalesce("next_top", reach) - 10, F.coalesce(F.nullif(F.col("decl"), F.lit(0)) - 10, reach))
    return out.withColumns({"block_top": F.col("top") - BLOCK_ABOVE, "block_bottom": F.least(reach, limit)}).drop("next_top", "decl")


def block_words(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """Words of every block; ``a_`` columns hold the anchor."""
    a = anchors.where("block_bottom >= block_top").select(*PAGE, F.struct(
        F.col("top").cast("bigint").alias("a_top"), "idx", "block_top", "block_bottom",
        *[F.col(c).alias(f"a_{c}") for c in ("seq", "lft", "right", "bottom")]).alias("b"))
    shelf = lambda c: F.floor(F.col(c) / SHELF)
    # A block lies on every shelf it touches; a word looks at the blocks of its own shelf: no page-wide pairing.
    shelves = (a.select(*PAGE, "b", F.explode(F.sequence(shelf("b.block_top"), shelf("b.block_bottom"))).alias("shelf"))
               .groupBy(*PAGE, "shelf").agg(F.collect_list("b").alias("bs")))
    facts = shelves.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("shelf", "bs"))).alias("s"))
    facts = facts.select(*PAGE, F.col("s.bs").alias("blocks"), F.get("s", F.lit(0))["shelf"].alias("first"), _cells(F.col("s.shelf"), 1).alias("cells"))
    # Plain look-ups only: a function over the page's blocks would leave generated code and copy them all for every word.
    place = F.get("cells", (shelf("top") - F.col("first")).cast("int"))
    inside = on_pages(words.where("top is not null"), facts).select(*words.columns, F.explode(F.get("blocks", place)).alias("near"))
    inside = inside.where(F.col("top").between(F.col("near.block_top"), F.col("near.block_bottom"))).select(*words.columns, "near.*")
    return boxes(inside).withColumn("label", tx.is_printed_label(F.col("text")))


def _region(y_min, y_max, x_min=None, x_max=None) -> Column:
    """Non-label words of a region, edges included; unknown edges give no words."""
    cond = F.col("top").between(y_min, y_max) & ~F.col("label")
    if x_min is not None:
        cond = cond & (F.col("lft") >= x_min)
    if x_max is not None:
        cond = cond & (F.col("lft") <= x_max)
    return F.coalesce(cond, F.lit(False))


def _right_of(mark: str, y_tol: int, gap: int = 10, max_x: Column | None = None) -> Column:
    """Non-label words right of a marked word, on about its height."""
    cond = (F.abs(F.col("top") - F.col(f"{mark}.top")) <= y_tol) & (F.col("lft") > F.col(f"{mark}.right") + gap) & ~F.col("label")
    if max_x is not None:
        cond = cond & (F.col("lft") < max_x)
    return F.coalesce(cond, F.lit(False))


def _labels(inside: DataFrame, name_label: Column, addr: Column) -> DataFrame:
    """Join each block's label words (first in reading order of the word list) to its words.

    ``m_only`` is the 'ONLY' word beside the address label, else the label itself; ``dense`` marks blocks full of
    words, likely preamble. All but ``m_only`` are found in one window.
    """
    cols = ("lft", "top", "right", "bottom")
    listed = lambda pat: _first(_is(pat), *cols, order=("seq",))
    marks = {"m_name": name_label, "m_city": listed(r"^city:?$"), "m_zip": listed(r"^zip:?$"), "m_date": listed(r"^date:?$"),
             "m_sig": listed(r"^signature:?$"), "m_addr": _first(addr, *cols, order=("top", "lft"))}
    src = inside.withColumns({m: found.over(_block()) for m, found in marks.items()} | {
        "dense": F.count_if(~F.col("label")).over(_block()) > DENSE_WORDS})
    beside = _is(r"^only:?$") & (F.abs(F.col("top") - F.col("m_addr.top")) <= ROW_TOLERANCE)
    return src.withColumn("_o", _first(beside, *cols, order=("seq",)).over(_block())).withColumn("m_only", F.when(
        F.col("m_addr").isNotNull(), F.coalesce("_o", "m_addr"))).drop("_o")


def _gathered(src: DataFrame, fields: dict[str, Column], signed: Column) -> DataFrame:
    """One row a block: of each field an array of words for join_words, and signature_present, conf and dense.

    A word is kept once, with a bit for every field it belongs to.
    """
    bits = {f: 1 << i for i, f in enumerate(fields)}
    mask = sum((F.when(cond, bits[f]).otherwise(0) for f, cond in fields.items()), F.lit(0))
    word = F.struct("lft", "top", "seq", "right", "text", "fields")
    # Worked out before they are gathered: arguments of collect_list are not compiled.
    src = src.withColumns({"fields": mask, "signed": signed}).select(
        *PAGE, "idx", "conf", "dense", "signed", F.when(F.col("fields") != 0, word).alias("w"))
    rows = src.groupBy(*PAGE, "idx").agg(F.collect_list("w").alias("w"), F.max("signed").alias("signature_present"),
                                         F.avg("conf").alias("conf"), F.max("dense").alias("dense"))
    of = lambda bit: F.filter("w", lambda w: w["fields"].bitwiseAND(bit) != 0)
    return rows.withColumns({f: of(bit) for f, bit in bits.items()}).drop("w")


_NOT_CITY = r"^(state:?|zip:?|ca)$"


def extract_blocks(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Signer blocks around 'Print Name' labels that have a line number to their left."""
    # Read several times below; the words are looked through for labels once.
    anchors = cut(boxes(print_name_anchors(words)))
    top = anchors.groupBy(*PAGE).agg(F.min("top").alias("g"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    words = on_pages(words, top.select(*PAGE, "g")).where(F.col("top") >= F.col("g") - 200).drop("g")
    anchors = anchors.join(top.select(*PAGE), PAGE, "left_semi")
    digits = words.where(_is("^[1-7]$")).select(*[F.col(c).alias(f"d_{c}") for c in PAGE], F.col("top").alias("d_top"), F.col("lft").alias("d_lft")).distinct()
    left = ((F.col("d_lft") < F.col("lft")) & (F.col("d_lft") > F.col("lft") - 200) & (F.abs(F.col("d_top") - F.col("top")) <= 60))
    same = [F.col(c) == F.col(f"d_{c}") for c in PAGE]
    inside = block_words(blocks(anchors, words).join(digits.hint("shuffle_hash"), [*same, left], "left_semi"), words)
    inside = on_pages(inside, pages.select(*PAGE, "page_width"))
    inside = inside.withColumn("x_addr", F.col("a_lft") + F.floor(F.col("page_width") * 0.25))
    near_name = _is(r"^name:?$") & (F.abs(F.col("top") - F.col("a_top")) <= ROW_TOLERANCE) & (F.col("lft") > F.col("a_lft"))
    src = _labels(inside, _first(near_name, "lft", "top", "right", "bottom", order=("lft", "seq")),
                  _is(r"^(residence|address:?)$") & (F.col("lft") > F.col("x_addr") - 200))
    anchor = F.struct(F.col("a_lft").alias("lft"), F.col("a_top").alias("top"), F.col("a_right").alias("right"),
                      F.col("a_bottom").alias("bottom"))
    src = src.withColumn("m_name", F.coalesce("m_name", anchor))
    zipped = _is(ZIP)
    in_name = _right_of("m_name", ROW_TOLERANCE, max_x=F.col("x_addr"))
    below = _region(F.col("a_bottom"), F.col("a_bottom") + 30, F.col("a_lft"), F.col("x_addr"))
    street = _region(F.col("m_only.top") - 50, F.col("m_only.top") + 15, F.col("m_only.right") + 5) & ~zipped
    in_zip = _right_of("m_zip", ROW_TOLERANCE) & zipped
    city = _region(F.col("m_city.top") - 35, F.col("m_city.top") + 10, F.col("m_city.right") + 5,
                   F.coalesce(F.col("m_zip.lft") - 10, F.lit(99999))) & ~_is(_NOT_CITY) & ~zipped
    date = _region(F.col("m_date.top") - 40, F.col("m_date.top") + 10, F.col("m_date.right") + 5)
    sig_max = F.col("m_sig.lft") + 600
    signed = _right_of("m_sig", 50, 5, sig_max) | _region(F.col("m_sig.bottom"), F.col("m_sig.bottom") + 60, F.col("m_sig.lft"), sig_max)
    out = _gathered(src, {"name": in_name, "below": below, "street": street, "zip": in_zip, "city": city, "date": date}, signed)
    return _assembled(out.withColumn("name", F.when(F.size("name") > 0, F.col("name")).otherwise(F.col("below"))))


def extract_by_numbers(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Signer rows around line-number digits: by field labels where read, else by x-bands."""
    inside = on_pages(block_words(blocks(number_anchors(words), words), words), pages.select(*PAGE, "page_width"))
    x0 = F.col("a_right") + 10
    span = F.greatest(F.col("page_width") - x0, F.lit(1))
    # Right edge of each field as a share of the span.
    edges = {"sig": 0.15, "name": 0.38, "addr": 0.63, "city": 0.78, "zip": 0.90}
    inside = inside.withColumns({f"x_{k}": x0 + F.floor(span * v) for k, v in edges.items()})
    src = _labels(inside, _first(_is(r"^name:?$") & (F.col("lft") > F.col("a_right")), "lft", "top", "right", "bottom", order=("seq",)),
                  _is(r"^(residence|address:?)$"))
    x = lambda k: F.col(f"x_{k}")
    row = lambda lo, hi=None: _region(F.col("a_top") - ROW_TOLERANCE, F.col("a_top") + 2 * ROW_TOLERANCE, lo, hi)
    have = lambda m: F.col(m).isNotNull()
    zipped = _is(ZIP)
    name = F.when(have("m_name"), _right_of("m_name", ROW_TOLERANCE, max_x=x("name"))).otherwise(row(x("sig"), x("name")))
    street = F.when(have("m_only"), _region(F.col("m_only.top") - 50, F.col("m_only.top") + 15, F.col("m_only.right") + 5, x("addr"))
                    & ~zipped).otherwise(row(x("name"), x("addr")))
    in_zip = F.when(have("m_zip"), _right_of("m_zip", ROW_TOLERANCE)).otherwise(row(x("city"), x("zip"))) & zipped
    city = F.when(have("m_city"), _region(F.col("m_city.top") - 35, F.col("m_city.top") + 10, F.col("m_city.right") + 5,
                                          F.coalesce(F.col("m_zip.lft") - 10, x("city"))) & ~_is(_NOT_CITY) & ~zipped).otherwise(row(x("addr"), x("city")))
    date = F.when(have("m_date"), _region(F.col("m_date.top") - 40, F.col("m_date.top") + 10, F.col("m_date.right") + 5)).otherwise(row(x("zip")))
    signed = _region(F.col("a_top") - 60, F.col("a_top") + BLOCK_BELOW, F.col("a_right") + 5, x("sig"))
    return _assembled(_gathered(src, {"name": name, "street": street, "zip": in_zip, "city": city, "date": date}, signed))


def _assembled(rows: DataFrame) -> DataFrame:
    text = lambda c: join_words(F.col(c))
    out = rows.select(*PAGE, "idx", text("name").alias("raw_name"),
                      tx.join_nonempty(", ", text("street"), text("city"), text("zip")).alias("raw_address"),
                      text("date").alias("raw_date"), "signature_present", vl.round_py(F.col("conf"), 1).alias("ocr_confidence"), "dense")
    return _numbered(out, "idx")


def extract_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Signer rows of every page by the first way that gives any: headers, blocks, numbers, bands."""
    from .quality import first_strategy
    grid = cut(clip_to_grid(words))
    return first_strategy(PAGE, extract_by_headers(grid, pages), extract_blocks(grid, pages).drop("dense"),
                          extract_by_numbers(grid, pages).drop("dense"), extract_by_bands(grid, pages))


def words_after_label(words: DataFrame, pattern: str, reach: int = 80, tolerance: int = ROW_MERGE) -> DataFrame:
    """(page, label_seq, value): words right of each matching label on its row, else the row below."""
    label_word = r"^(print|name|residence|address|city|state|zip|date|signature|only|res\.?)$"
    src = boxes(words)
    labels = src.where(_is(pattern)).select(*PAGE, F.col("seq").alias("label_seq"), *[
        F.col(c).alias(f"l_{c}") for c in ("right", "cy", "bottom")])
    shelf = lambda c: F.floor(c / 100)
    spread = labels.withColumn("shelf", F.explode(F.sequence(shelf(F.col("l_cy") - 100), shelf(F.col("l_bottom") + reach + 100))))
    values = src.where(~F.regexp_replace("text", "^:+|:+$", "").rlike("(?i)" + label_word)).withColumn("shelf", shelf(F.col("top")))
    near = spread.join(values, [*PAGE, "shelf"])
    beside = (F.abs(F.col("cy") - F.col("l_cy")) <= tolerance) & (F.col("lft") > F.col("l_right") + 5)
    under = (F.col("top") > F.col("l_bottom")) & (F.col("top") <= F.col("l_bottom") + reach)
    near = near.where(beside | under).withColumns({"beside": beside, "under": under})
    top = near.groupBy(*PAGE, "label_seq").agg(F.min(F.when(F.col("under"), F.col("top"))).alias("first_top"), F.max("beside").alias("any_beside"))
    near = near.join(top, [*PAGE, "label_seq"])
    take = F.when(F.col("any_beside"), F.col("beside")).otherwise(F.col("under") & (F.col("top") - F.col("first_top") <= tolerance))
    out = near.groupBy(*PAGE, "label_seq").agg(_pick(take).alias("v"))
    return labels.select(*PAGE, "label_seq").join(out, [*PAGE, "label_seq"], "left").select(
        *PAGE, "label_seq", F.coalesce(join_words(F.col("v"), None), F.lit("")).alias("value"))


def cause_titles(words: DataFrame, pages: DataFrame, share: float = 0.15, n: int = 8) -> DataFrame:
    """(page, cause): the first ``n`` longer, non-numeric words of the top of the page."""
    top = words.join(pages.select(*PAGE, "page_height"), PAGE).where(F.col("top") < F.col("page_height") * share)
    good = top.where(~F.col("text").rlike(r"^[\d.\-:,]+$") & (F.length("text") > 1))
    w = Window.partitionBy(*PAGE).orderBy("top", "lft", "seq")
    kept = good.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    title = kept.groupBy(*PAGE).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), " ").alias("cause"))
    return pages.select(*PAGE).join(title, PAGE, "left").withColumn("cause", F.coalesce(F.trim("cause"), F.lit("")))


def row_confidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("n_words"), vl.round_py(F.avg("conf"), 1).alias("ocr_confidence"))
