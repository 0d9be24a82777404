"""Clock events to shifts, over whole histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_punches(punches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shifts, verdicts) of in/out events taken in (ts, event_id) order per worker.

    An 'in' while clocked in is rejected; an 'out' closes the open shift unless it is
    not later than its 'in'; an 'out' without an open shift is rejected. Events of one
    instant are gathered (there are few), and each instant then maps 'in or out before'
    to 'in or out after': either a fixed state or a switch. So the state before any
    instant is the last fixed one, switched as often as there were switches since, and
    plain windows find it without walking the events one by one.
    """
    at = punches.groupBy("worker_id", "ts").agg(F.array_sort(F.collect_list(F.struct("event_id", "kind"))).alias("ev"))
    kind_at = lambda arr, k: F.array_position(F.transform(arr, lambda e: e["kind"]), F.lit(k)).cast("int")
    at = at.withColumns({"first_in": kind_at(F.col("ev"), "in"), "first_out": kind_at(F.col("ev"), "out")})
    has_in, has_out = F.col("first_in") > 0, F.col("first_out") > 0
    rest = F.slice("ev", F.col("first_out") + 1, F.size("ev"))
    at = at.withColumn("in_again", F.when(has_out, kind_at(rest, "in")).otherwise(0))  # 'in' after the first 'out'
    at = at.withColumn("fixed", F.when(~has_out, True).when(~has_in, False).when(F.col("in_again") > 0, True))

    chunk = ["worker_id", "day"]
    at = at.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy(*chunk).orderBy("ts")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    switch = F.col("fixed").isNull().cast("int")
    at = at.withColumn("switches", F.sum(switch).over(w))
    at = at.withColumn("seen", F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "switches")), ignorenulls=True).over(before))

    days = at.groupBy(*chunk).agg(
        F.sum(switch).alias("turns"), F.max_by(F.struct("fixed", "switches"), F.when(F.col("fixed").isNotNull(), F.col("ts"))).alias("end"))
    days = days.withColumn("ends_in", F.col("end.fixed") != ((F.col("turns") - F.col("end.switches")) % 2 == 1))
    earlier_days = Window.partitionBy("worker_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.when(F.col("ends_in").isNull(), F.col("turns")).otherwise(0)
    days = days.withColumn("turned", F.coalesce(F.sum(turned).over(earlier_days), F.lit(0)))
    known = F.last(F.when(F.col("ends_in").isNotNull(), F.struct("ends_in", "turned")), ignorenulls=True).over(earlier_days)
    days = days.withColumn("known", known)
    came_in = F.coalesce("known.ends_in", F.lit(False)) != ((F.col("turned") - F.coalesce("known.turned", F.lit(0))) % 2 == 1)

    at = at.join(days.select(*chunk, came_in.alias("came_in")), chunk)
    earlier = F.col("switches") - switch
    since = earlier - F.coalesce("seen.switches", F.lit(0))
    at = at.withColumn("was_in", F.coalesce("seen.fixed", "came_in") != (since % 2 == 1))
    # Position of the event that opens a shift in this instant, if one does.
    opener = F.when(~F.col("was_in") & has_in, F.col("first_in")).when(
        F.col("was_in") & (F.col("in_again") > 0), F.col("first_out") + F.col("in_again"))
    at = at.withColumn("opener", opener)
    opened = F.when(F.col("opener").isNotNull(), F.struct(F.col("ts").alias("clock_in"), F.expr("ev[opener - 1].event_id").alias("shift_id")))
    at = at.withColumn("opened", opened)
    left = at.groupBy(*chunk).agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("ts"))).alias("left"))
    left = left.select(*chunk, F.last("left", ignorenulls=True).over(earlier_days).alias("left"))
    at = at.withColumn("own", F.last("opened", ignorenulls=True).over(before)).join(left, chunk).withColumn("open_shift", F.coalesce("own", "left"))
    shifts = at.where(F.col("was_in") & has_out).select(
        "worker_id", "open_shift.shift_id", "open_shift.clock_in", F.col("ts").alias("clock_out"))

    one = at.select("worker_id", "ts", "was_in", "first_out", "opener", F.posexplode("ev").alias("i", "e"))
    pos = F.col("i") + 1
    verdict = (F.when((F.col("e.kind") == "in") & (pos == F.col("opener")), "accepted")
               .when(F.col("e.kind") == "in", "already_in")
               .when(F.col("was_in") & (pos == F.col("first_out")), "accepted")
               .when(F.coalesce(pos > F.col("opener"), F.lit(False)), "out_not_after_in").otherwise("not_in"))
    return shifts, one.select("worker_id", "ts", F.col("e.event_id").alias("event_id"), F.col("e.kind").alias("kind"), verdict.alias("verdict"))
