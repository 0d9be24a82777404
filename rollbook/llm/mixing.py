"""Mixing sources to target weights by thresholds on a hash of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workforce import global_rank
from ..session import cut
from .common import attach, running, set_aside, word_count

BITS, LEVELS = 12, 5  # 60 bits of hash, looked at 12 by 12


def place(doc_id: Column) -> Column:
    """A fixed point of 0 .. 2^60 - 1 for each id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` by turns. ``share`` times
    all sizes is dealt out by weight; a target stops at ``most`` times its source's
    size and what is over is dealt to the others, until none is above. Each turn is
    one aggregate over the table of sources and brings one row to the driver.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap")))
    level = 0.0
    while True:
        full = F.col("cap") < F.col("w") * level
        total, spent, left = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        new = (total * share - spent) / left if left else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


@set_aside
def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes a document.

    Size is the number of words. A source whose target is k whole rounds and a rest gets
    every document k times and once more those whose hash lies under the source's
    threshold. The thresholds come from histograms: sizes are summed by source and the
    hash's first 12 bits, the first bucket that overflows the rest is looked into by the
    next 12 bits, and so on; only that bucket's rows are read again and nothing is sorted.
    A larger share gives a mix that contains the smaller one, and reruns agree.

    Null text has size 0. Null is a source of its own, and a null id a point like any
    other. Rows with one id share its fate. A source of size 0 has target 0 and gives
    nothing; an empty table gives an empty mix. Columns named like the new ones are
    replaced; all others are kept.
    """
    new = ["size", "source_size", "target", "copies", "_h", "_rounds", "_bound"]
    docs = docs.drop(*new).withColumn("size", word_count(F.col("text"))).withColumn("_h", place(F.col("doc_id")))
    narrow = cut(docs.select("source", "size", "_h"))
    limits = thresholds(narrow, weights, share, most)
    out = attach(docs, limits, "source")
    copies = F.col("_rounds") + F.when(F.col("_h") < F.col("_bound"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("_h", "_rounds", "_bound")


def thresholds(narrow: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source: source_size, target, whole rounds and the bound of the hash for the rest."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    rounds = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    open_ = cut(source_targets(sizes, weights, share, most).withColumn("_rounds", rounds).withColumn(
        "_rest", target - F.col("_rounds") * size).withColumn("_bound", F.lit(0).cast("long")))
    rows = attach(narrow, open_.select("source", "_rest"), "source")
    done = open_.drop("_rest")
    for depth in range(LEVELS):
        shift = BITS * (LEVELS - 1 - depth)
        by = rows.groupBy("source", "_rest", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_s"))
        before = running("source", "_b", "_s")
        # The first bucket that does not fit whole; where all fit there is none.
        over = by.withColumn("_before", before).where(F.col("_before") + F.col("_s") > F.col("_rest"))
        first = over.groupBy("source").agg(
            F.min_by(F.struct("_b", (F.col("_rest") - F.col("_before")).alias("_rest")), "_b").alias("x"))
        edge = cut(first.select("source", F.col("x._b").alias("_edge"), F.col("x._rest").alias("_rest")))
        rows = attach(rows.drop("_rest"), edge, "source").where(F.shiftright("_h", shift) == F.col("_edge")).select(
            "source", "size", "_h", "_rest")
    return attach(done.drop("_bound"), edge.select("source", F.col("_edge").alias("_bound")), "source").withColumn(
        "_bound", F.coalesce("_bound", F.lit(1 << 60)))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as it is taken, with its copy number."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
