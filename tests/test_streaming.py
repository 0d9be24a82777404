"""Every stream gives what its batch twin gives."""

import pytest
from pyspark.sql import functions as F

from rollbook.operators import clock, linkage, similar, workforce
from rollbook.plans.views import Views
from rollbook.sources import buckets, files
from rollbook.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def as_stream(spark, df, path, order, parts=3):
    """``df`` written as files in order and read back one file a trigger."""
    rows = df.orderBy(order).toPandas()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows.iloc[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return q


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_latest_counts(spark, v, tmp_path):
    src = as_stream(spark, v.live_events, str(tmp_path / "in"), "ts")
    run(live.latest_counts_stream(src), "counts", tmp_path, "complete")
    assert rows(spark.table("counts"), "worker_id", "sig_count") == rows(workforce.latest_counts(v.live_events), "worker_id", "sig_count")


def test_latest_positions(spark, v, tmp_path):
    src = as_stream(spark, v.pins, str(tmp_path / "in"), "ts")
    run(live.latest_positions_stream(src), "pins", tmp_path, "complete")
    assert rows(spark.table("pins"), "worker_id", "lat", "lng") == rows(workforce.latest_positions(v.pins), "worker_id", "lat", "lng")


def test_upsert_sink_keeps_the_latest(spark, v, tmp_path):
    src = as_stream(spark, v.live_events, str(tmp_path / "in"), "ts")
    q = (src.writeStream.foreachBatch(live.upsert_sink(str(tmp_path / "t"), ["worker_id"], ["ts", "event_id"]))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = buckets.read_buckets(spark, str(tmp_path / "t"))
    assert rows(got, "worker_id", "sig_count") == rows(workforce.latest_counts(v.live_events), "worker_id", "sig_count")


def test_clock_events(spark, v, tmp_path):
    src = as_stream(spark, v.punches, str(tmp_path / "in"), "ts")
    run(live.clock_stream(src), "clock", tmp_path, "append")
    shifts, verdicts = clock.pair_punches(v.punches)
    assert rows(spark.table("clock"), "event_id", "verdict") == rows(verdicts, "event_id", "verdict")
    closed = spark.table("clock").where("clock_out is not null")
    assert rows(closed, "worker_id", "shift_id") == rows(shifts, "worker_id", "shift_id")


def test_clock_ties_follow_the_event_order(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    ev = [(1, 1, t(0), "out"), (1, 2, t(1), "in"), (1, 3, t(1), "out"), (1, 4, t(1), "in"), (1, 5, t(2), "out"), (1, 6, t(2), "in"),
          (1, 7, t(2), "out"), (1, 8, t(3), "out"), (1, 9, t(3), "in"), (1, 10, t(4), "in"), (1, 11, t(5), "in"), (1, 12, t(5), "out")]
    df = spark.createDataFrame(ev, "worker_id long, event_id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = ["not_in", "accepted", "out_not_after_in", "already_in", "accepted", "accepted", "out_not_after_in", "accepted",
            "accepted", "already_in", "already_in", "accepted"]
    shifts, verdicts = clock.pair_punches(df)
    assert [r.verdict for r in verdicts.orderBy("event_id").collect()] == want
    assert sorted(r.shift_id for r in shifts.collect()) == [2, 6, 9]


def test_duplicates(spark, v, tmp_path):
    n = linkage.normalize_lines(v.lines.where("project_id < 40")).select(
        "project_id", "line_number", "first_name", "last_name", "street", "city", "zip_code", "search_key")
    want = rows(similar.find_duplicates(n), "project_id", "line_number", "duplicate_of_line")
    src = as_stream(spark, n, str(tmp_path / "in"), "line_number")
    run(live.duplicates_stream(src), "dups", tmp_path, "append")
    assert rows(spark.table("dups"), "project_id", "line_number", "duplicate_of_line") == want


def test_daily_counts_close_behind_the_watermark(spark, v, tmp_path):
    src = as_stream(spark, v.entries, str(tmp_path / "in"), "created_at")
    run(live.daily_counts_stream(src), "days", tmp_path, "append")
    got = set(rows(spark.table("days"), "worker_id", "day", "day_sigs"))
    batch = set(rows(workforce.daily_counts(v.entries), "worker_id", "day", "day_sigs"))
    assert got and got <= batch and {d for _, d, _ in batch - got} <= {"2024-01-28", "2024-01-29", "2024-01-30"}


def test_clock_of_a_busy_worker(spark):
    """Against a plain fold: many days of one worker, ties of instants, open shifts carried over days."""
    import random
    from collections import Counter
    from datetime import datetime, timedelta
    r, start = random.Random(8), datetime(2024, 1, 1)
    events = [(w, i, start + timedelta(minutes=30 * r.randrange(20_000 if w else 300)), r.choice(["in", "out", "out"] if i % 3 else ["in"]))
              for w, n in ((0, 400), (1, 2500)) for i in range(n)]
    shifts, verdicts = [], []
    for w in (0, 1):
        opened = None
        for _, i, ts, kind in sorted((e for e in events if e[0] == w), key=lambda e: (e[2], e[1])):
            if kind == "in":
                said = "already_in" if opened else "accepted"
                opened = opened or (ts, i)
            else:
                said = "not_in" if not opened else "out_not_after_in" if ts <= opened[0] else "accepted"
                if said == "accepted":
                    shifts.append((w, opened[1], opened[0], ts))
                    opened = None
            verdicts.append((w, ts, i, kind, said))
    got = clock.pair_punches(spark.createDataFrame(events, "worker_id long, event_id long, ts timestamp_ntz, kind string"))
    assert Counter(tuple(x) for x in got[0].collect()) == Counter(shifts)
    assert Counter(tuple(x) for x in got[1].collect()) == Counter(verdicts)


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sheets")
    sheets = lambda *ids: spark.createDataFrame([(i, n, f"{tag} {n}") for i, tag in ids for n in range(3)], "project_id long, line_number int, raw_name string")
    files.save_sheets(sheets(*((i, "first") for i in range(200))), path)
    before = rows(buckets.read_buckets(spark, path), "project_id", "line_number", "raw_name")
    assert len(before) == 600
    data = lambda: sorted(str(p.relative_to(path)) for p in (tmp_path / "sheets" / "data").rglob("part-*.parquet"))
    assert 50 <= len(data()) <= buckets.BUCKETS

    def broken(*_):
        raise OSError("lost")
    monkeypatch.setattr(buckets, "commit", broken)
    with pytest.raises(OSError, match="lost"):
        files.save_sheets(sheets((3, "second")), path)
    assert rows(buckets.read_buckets(spark, path), "project_id", "line_number", "raw_name") == before
    monkeypatch.undo()

    files.save_sheets(sheets((3, "third"), (900, "new")), path)
    got = rows(buckets.read_buckets(spark, path), "project_id", "line_number", "raw_name")
    assert got == sorted([r for r in before if r[0] != 3] + [(3, n, f"third {n}") for n in range(3)] + [(900, n, f"new {n}") for n in range(3)], key=repr)
    assert len([f for f in data() if "gen=1" in f]) <= 2  # two buckets at most are written anew
    assert buckets.last_commit(spark, path)["gen"] == 1


def test_generations_that_no_bucket_is_in_go(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k long, v long")
    keep = lambda past, new: new
    for g in range(4):
        buckets.change(row(1, g), path, ["k"], keep)
    assert rows(buckets.read_buckets(spark, path), "k", "v") == [(1, 3)]
    assert [p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()] == ["gen=3"]
    assert buckets.change(row(1, 9), path, ["k"], keep, gen=2) == 3  # an earlier batch that comes again
    assert rows(buckets.read_buckets(spark, path), "k", "v") == [(1, 3)]
    buckets.change(row(1, 9), path, ["k"], lambda past, new: new.limit(0))
    assert buckets.last_commit(spark, path)["places"] == {}
    assert buckets.read_buckets(spark, path) is None


def test_late_rows_are_kept_aside(spark, tmp_path):
    written = {}
    sink = live.side_sink(lambda df, i: written.__setitem__(i, rows(df, "id")), str(tmp_path), "ts", "2 hours")
    batch = lambda *r: spark.createDataFrame([(i, f"2024-01-01 {h:02d}:00:00") for i, h in r], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sink(batch((1, 5), (2, 1)), 0)  # nothing is late at first
    sink(batch((3, 9), (4, 4), (5, 2)), 1)
    sink(batch((3, 9), (4, 4), (5, 2)), 1)  # again
    sink(batch((6, 6), (7, 7), (8, 9)), 2)
    assert written == {0: [(1,), (2,)], 1: [(3,), (4,)], 2: [(7,), (8,)]}
    assert rows(spark.read.parquet(str(tmp_path / "late")), "batch", "id") == [(1, 5), (2, 6)]


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    for h in (1, 20, 21, 2):  # the last comes after its day was closed, one batch later than the mark
        spark.createDataFrame([(1, f"2024-01-{h:02d} 08:00:00", 3)], "worker_id long, created_at string, sig_count long").withColumn(
            "created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("worker_id long, created_at timestamp, sig_count long").option("maxFilesPerTrigger", 1).parquet(src)
    days = stream.withWatermark("created_at", "1 day").groupBy("worker_id", F.window("created_at", "1 day")).agg(F.sum("sig_count").alias("n"))
    q = run(days, "late_days", tmp_path, "append")
    assert live.rows_dropped(q) == 1


def test_total_of_the_stream(spark, v, tmp_path):
    src = as_stream(spark, v.entries, str(tmp_path / "in"), "created_at")
    run(live.total_valid_stream(src), "total", tmp_path, "complete")
    want = live.total_valid_stream(v.entries)
    assert rows(spark.table("total"), *want.columns) == rows(want, *want.columns)


def test_page_check_versions_new_packets(spark):
    history = spark.createDataFrame([(1, "00000000000000ff", "done"), (2, "ffffffff00000000", "done"), (3, "00000000000000ff", "open")], "packet_id long, fp string, status string")
    known = spark.createDataFrame([(1, "JANE SMITH|1 MAIN ST#0f", "new_signature"), (3, "OTHER NAME|9 OAK#0f", "new_signature")],
                                  "packet_id long, row_fingerprint string, row_status string")
    new = spark.createDataFrame([(9, "00000000000000fe", 1, "new_signature", "JANE SMITH|1 MAIN ST#0f"), (9, "00000000000000fe", 2, "new_signature", "QQQ ZZZZZ|77 XXX#f0"),
                                 (9, "00000000000000fe", 3, "blank", "|#00"), (8, "0f0f0f0f0f0f0f0f", 1, "new_signature", "JANE SMITH|1 MAIN ST#0f")],
                                "packet_id long, fp string, line_no int, row_status string, row_fingerprint string")
    seen = {}
    live.page_check(history, known, lambda df, i: seen.update({i: rows(df, "packet_id", "line_no", "row_status")}))(new, 5)
    assert seen[5] == [(8, 1, "new_signature"), (9, 1, "already_counted"), (9, 2, "new_signature"), (9, 3, "blank")]
