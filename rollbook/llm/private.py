"""Personal data: patterns that find seeds, and contexts learned from them that find more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import set_aside

KINDS = ["email", "ip", "card", "phone"]
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
# Matches that fail the tests below on their number of digits are left out of the patterns
# where no other match could begin inside them. All loops are possessive: time is linear
# and the depth of calls does not grow with the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9](?:[\x20().-]*+[0-9]){8,}+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# A run of digits, or a word that holds a digit or @, with the groups of digits that follow it.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[(]?[0-9][^\x20\x09-\x0D]*+)*+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str) -> Column:
    """Start, end (code points, exclusive) and value of each match, leftmost first: matches and the gaps between them."""
    none = F.array().cast(_SPAN)

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        step = lambda acc, x: _let(acc["at"] + F.length(x["gap"]), lambda start: F.struct(
            (start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))).alias("out")))
        pairs = _let(gaps, lambda g: F.zip_with(hits, F.slice(g, 1, F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("gap"))))
        return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that the fixed patterns find in a text."""
    none = F.array().cast(_SPAN)
    some = lambda mark, spans: F.when(F.contains(text, F.lit(mark)), spans).otherwise(none)
    long = lambda low, high: lambda x: _let(F.length(_digits(x["value"])), lambda n: (n >= low) & (n <= high))
    return {
        "email": some("@", _spans(text, _EMAIL)),
        "ip": some(".", F.filter(_spans(text, _IP), lambda x: x["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        "card": F.filter(F.filter(_spans(text, _CARD), long(13, 19)), lambda x: F.call_function("luhn_check", _digits(x["value"]))),
        "phone": some("+", F.filter(_spans(text, _PHONE), long(9, 15))),
    }


def _candidates(text: Column) -> Column:
    """Identifier-like spans with the last two words before each, in lower case, as ``pattern``.

    A span loses the marks around it. Words are looked for in the 80 characters before.
    """
    def shaped(x: Column) -> Column:
        head = F.length(F.regexp_extract(x["value"], r"^[\"'(<\[{.,;:!?]*+", 0))
        value = F.regexp_replace(F.regexp_replace(x["value"], r"^[\"'(<\[{.,;:!?]++", ""), r"[\"')>\]}.,;:!?]+$", "")
        start = x["start"] + head
        before = F.lower(F.substring(text, F.greatest(start - 80, F.lit(0)).cast("int") + 1, F.least(start, F.lit(80)).cast("int")))
        words = F.regexp_extract(before, r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D\"'(<\[{]*$", 1)
        return _let(value, lambda v: F.struct(
            start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"),
            F.regexp_replace(words, r"[\x20\x09-\x0D]+", " ").alias("pattern")))

    found = F.transform(_spans(text, _CANDIDATE), shaped)
    kept = F.filter(found, lambda x: (x["pattern"] != "") & (
        (F.length(_digits(x["value"])) >= 5) | x["value"].rlike("^[^@]++@[^@]++$")))
    return F.when(text.rlike("[0-9@]"), kept).otherwise(F.array().cast(
        "array<struct<start:bigint,end:bigint,value:string,pattern:string>>"))


def patterns(seen: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(pattern, kind, trust) of the contexts that are trusted, from candidates (pattern, value, seed).

    Pattern and value are the two sides of a graph. Known values, at first the seeds with
    score 1, give each pattern for each kind the share of its distinct values that belong
    to it; a pattern is trusted from ``confidence`` on if ``support`` known values stand
    behind it. Trusted patterns give their values that are no seeds a score, 1 less the
    product of what each of them leaves open. Then patterns are scored again, ``rounds``
    times in all. All steps are aggregates and equi-joins on pattern or value.
    """
    edges = cut(seen.groupBy("pattern", "value").agg(F.min("seed").alias("seed")))
    seeds = edges.where("seed IS NOT NULL").groupBy("value").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("score"))
    known = cut(seeds)
    seeds = known
    for i in range(rounds):
        by_kind = edges.join(known, "value", "left").groupBy("pattern", "kind").agg(
            F.sum(F.coalesce("score", F.lit(0.0))).alias("mass"), F.count(F.lit(1)).alias("n"), F.count("score").alias("back"))
        best = by_kind.groupBy("pattern").agg(
            F.sum("n").alias("n"), F.max_by(F.struct("kind", "mass", "back"), F.struct("mass", "kind")).alias("b"))
        trusted = cut(best.select("pattern", "b.kind", (F.col("b.mass") / F.col("n")).alias("trust"), "b.back").where(
            (F.col("back") >= support) & (F.col("trust") >= confidence)).drop("back"))
        if i < rounds - 1:
            new = edges.join(trusted, "pattern").join(seeds.select("value"), "value", "left_anti").groupBy("value", "kind").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score"))
            new = new.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("value", "b.*")
            known = cut(seeds.unionByName(new))
    return trusted


@set_aside
def find(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``spans``: arrays of (kind, start, end) by kind, then start.

    ``base`` has what the fixed patterns of emails, IP addresses, cards and phones find.
    ``spans`` also has identifiers in contexts that the corpus shows to announce such a
    kind: candidates are words with five digits or an @; the two words before one are its
    pattern; ``patterns`` says which patterns are trusted. Base spans always stay; a
    learned span never overlaps one.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated
    rows get equal results and count as one value in the scores. An empty table gives no
    rows. Columns named like the new ones are replaced, all others but the text are kept.
    The text is read once; what is written and joined are spans, keyed by a row number.
    """
    docs = docs.drop("base", "spans", "_row", "_c", "_b")
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = _let(text, lambda t: F.struct(*(v.alias(k) for k, v in base_spans(t).items()), _candidates(t).alias("seen")))
    rows = cut(docs.select(*rest, F.monotonically_increasing_id().alias("_row"), own.alias("_b")))
    kind = lambda spans, k: F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.concat(*(kind(F.col(f"_b.{k}"), i) for i, k in enumerate(KINDS)))
    rows = rows.withColumn("base", base)
    seen = rows.where(F.size("_b.seen") > 0).select("_row", "base", F.explode("_b.seen").alias("x")).select(
        "_row", "x.*", F.get(F.filter("base", lambda b: (b["start"] < F.col("x.end")) & (b["end"] > F.col("x.start"))), F.lit(0))["kind"].alias("seed"))
    seen = cut(seen)
    trusted = patterns(seen, rounds, support, confidence)
    learned = seen.where("seed IS NULL").join(trusted, "pattern").groupBy("_row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    out = rows.drop("_b").join(learned, "_row", "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce("_more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))))
    named = lambda c: F.transform(c, lambda x: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(*rest, named(F.col("base")).alias("base"), named(F.col("spans")).alias("spans"))
