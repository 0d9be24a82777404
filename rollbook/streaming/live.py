"""Structured Streaming twins of the live figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.similarity import PairScorer, sort_tokens
from ..functions.text import exact_key


def latest_counts_stream(events: DataFrame) -> DataFrame:
    """Running last count per worker (update or complete mode)."""
    return events.groupBy("worker_id").agg(
        F.max_by(F.struct("ts", "event_id", "sig_count"), F.struct("ts", "event_id")).alias("r")).select("worker_id", "r.*")


def latest_positions_stream(pins: DataFrame) -> DataFrame:
    """Running last position per worker; an event with null lat and lng clears it."""
    return pins.groupBy("worker_id").agg(
        F.max_by(F.struct("ts", "event_id", "lat", "lng"), F.struct("ts", "event_id")).alias("r")).select("worker_id", "r.*")


def total_valid_stream(headers: DataFrame) -> DataFrame:
    """Running total of approved signatures (complete mode)."""
    return headers.agg(F.coalesce(F.sum("approved"), F.lit(0)).alias("total_valid_sigs"))


def daily_counts_stream(entries: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Approved signatures per worker and day; a day closes once the watermark passes it.

    Entries later than ``lateness`` are dropped here (and counted in the query's
    progress as numRowsDroppedByWatermark); the batch recompute takes them in.
    """
    return (entries.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
            .groupBy(F.window("created_at", "1 day"), "worker_id")
            .agg(F.sum(F.coalesce("approved", F.lit(0))).alias("day_sigs"))
            .select("worker_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "day_sigs"))


def rows_dropped(query) -> int:
    """Rows a streaming query has dropped as too late."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


SHIFT_EVENT = "worker_id long, event_id long, kind string, verdict string, shift_id long, clock_in timestamp, clock_out timestamp"


def clock_stream(punches: DataFrame) -> DataFrame:
    """Verdict of every clock event, with the shift each accepted 'out' closes.

    State per worker is the open shift. Events of a batch are taken in (ts, event_id)
    order; batches must arrive in order, as live clock events do.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, shift = (state.get if state.exists else (None, None))
        opened = pd.Timestamp(opened, unit="us") if opened is not None else None
        out = []
        for ev in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            row = dict(worker_id=key[0], event_id=ev.event_id, kind=ev.kind, shift_id=None, clock_in=None, clock_out=None)
            if ev.kind == "in":
                row["verdict"] = "already_in" if opened is not None else "accepted"
                if opened is None:
                    opened, shift = ev.ts, ev.event_id
            elif opened is None:
                row["verdict"] = "not_in"
            elif ev.ts <= opened:
                row["verdict"] = "out_not_after_in"
            else:
                row.update(verdict="accepted", shift_id=shift, clock_in=opened, clock_out=ev.ts)
                opened = shift = None
            out.append(row)
        if opened is None:
            state.remove()
        else:
            state.update((opened.value // 1000, int(shift)))
        cols = ["worker_id", "event_id", "kind", "verdict", "shift_id", "clock_in", "clock_out"]
        frame = pd.DataFrame(out, columns=cols)
        frame["shift_id"] = frame["shift_id"].astype("Int64")
        for c in ("clock_in", "clock_out"):
            frame[c] = pd.to_datetime(frame[c])
        yield frame

    typed = punches.select(F.col("worker_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp"), "kind")
    return typed.groupBy("worker_id").applyInPandasWithState(
        step, SHIFT_EVENT, "opened long, shift long", "append", GroupStateTimeout.NoTimeout)


def duplicates_stream(lines: DataFrame, threshold: float = 92) -> DataFrame:
    """duplicate_of_line per line, the kept lines of each sheet held as state.

    ``lines`` are normalized; lines of a sheet must arrive in line order.
    """
    schema = "project_id long, line_number int, duplicate_of_line int"
    kept = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
                         T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, texts, nums = (map(list, state.get) if state.exists else ([], [], []))
        by_key = {k: n for k, n in zip(keys, nums) if k}
        out = []
        for row in pd.concat(list(batches)).sort_values("line_number").itertuples():
            found = by_key.get(row.xkey) if row.xkey else None
            if found is None and row.txt and texts:
                score = PairScorer(texts, [row.txt])
                i = np.arange(len(texts))
                hits = np.flatnonzero(score.ratio(i, np.zeros(len(texts), int)) >= threshold)
                found = nums[hits[0]] if len(hits) else None
            if found is None:
                keys.append(row.xkey), texts.append(row.txt), nums.append(int(row.line_number))
                if row.xkey:
                    by_key[row.xkey] = int(row.line_number)
            out.append((key[0], int(row.line_number), found))
        state.update((keys, texts, nums))
        frame = pd.DataFrame(out, columns=["project_id", "line_number", "duplicate_of_line"])
        frame["duplicate_of_line"] = frame["duplicate_of_line"].astype("Int64")
        yield frame

    src = lines.select(
        F.col("project_id").cast("long"), F.col("line_number").cast("int"),
        exact_key(F.col("last_name"), F.col("first_name"), F.col("street"), F.col("city"), F.col("zip_code")).alias("xkey"),
        sort_tokens(F.col("search_key")).alias("txt"))
    return src.groupBy("project_id").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)


def page_check(history_pages: DataFrame, history_rows: DataFrame, write):
    """foreachBatch function: version the rows of new packets against a static history.

    The stream carries packet_id, fp, line_no, row_status, row_fingerprint; ``write``
    gets the versioned rows and the batch id.
    """
    from ..operators.resheet import earlier_rows, version_rows

    def run(batch: DataFrame, batch_id: int) -> None:
        pages = batch.select("packet_id", "fp").distinct().withColumn("status", F.lit("new"))
        known = history_pages.select("packet_id", "fp", "status").unionByName(pages)
        # New packets are asked about; only done ones answer.
        found = earlier_rows(known, history_rows).join(pages.select("packet_id"), "packet_id", "left_semi")
        write(version_rows(batch, found), batch_id)

    return run


def upsert_sink(path: str, keys: list[str], version: list[str]):
    """foreachBatch function keeping one latest row a key in a table of buckets.

    A batch rewrites the buckets of its keys only; one that comes again after a restart is passed over.
    """
    from ..operators.tables import latest_by
    from ..sources.buckets import change

    def run(batch: DataFrame, batch_id: int) -> None:
        change(batch, path, keys, lambda past, new: latest_by(new if past is None else past.unionByName(new), keys, version), batch_id)

    return run


def side_sink(write, path: str, ts: str, delay: str):
    """foreachBatch function: rows over ``delay`` older than the newest row of earlier batches go to ``path``/late.

    A watermark drops such rows without a trace; ``write`` gets the others and the batch id. The newest time of every
    batch is kept under ``path``/marks, so a restart knows it, and a batch that comes again replaces what it wrote.
    """
    from ..sources.buckets import _exists

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        known = spark.read.parquet(marks).where(F.col("batch") < batch_id) if _exists(spark, marks) else None
        newest = known.agg(F.max("newest")).first()[0] if known is not None else None
        behind = F.col(ts) < F.lit(newest).cast(batch.schema[ts].dataType) - F.expr(f"interval {delay}") if newest is not None else F.lit(False)
        batch = batch.persist()
        try:
            batch.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            write(batch.where(~F.coalesce(behind, F.lit(False))), batch_id)
            batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        finally:
            batch.unpersist()

    return run
