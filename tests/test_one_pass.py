"""Rules over sheet lines read and shuffle their lines once, with the results they had."""

import re

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as tx
from rollbook.operators import packet_rules, quality, sheet_rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_strip_knows_all_white_space(spark):
    chars = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000 and i]
    rows = [(f"{c} x{c}y {c}",) for c in chars] + [("",), (" ",), (None,)]
    out = spark.createDataFrame(rows, "t string").select(tx.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b"))
    assert out.where("not (a <=> b)").count() == 0


PACKET = [(1, i, "new_signature", "a b", f"{a} oak st", c, "") for i, (a, c) in enumerate(
    [("10", "x"), ("12", "X "), ("12", "x"), ("30", "x"), ("36", "x"), ("5", "y"), ("6", "y"), ("no", "y")])]
PACKET_SCHEMA = "packet_id long, line_no int, row_status string, raw_name string, raw_address string, raw_city string, norm_name string"


def test_near_sequences_shuffle_once(spark):
    out = packet_rules.near_sequences(spark.createDataFrame(PACKET, PACKET_SCHEMA))
    assert exchanges(out) == 1
    assert {r.line_no for r in out.collect()} == {0, 1, 2}


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_city_runs_read_lines_once(spark, chunk):
    read = spark.sparkContext.accumulator(0)
    rows = [(1, i, "new_signature", "a b", "", c, "") for i, c in enumerate("xxxxxyyxyyyyyyz")] + [
        (2, i, "new_signature", "a b", "", "", "") for i in range(5)]
    seen = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (read.add(1), r)[1]), PACKET_SCHEMA)
    out = packet_rules.city_runs(seen, chunk_rows=chunk).collect()
    assert sorted((r.packet_id, r.line_no) for r in out) == sorted(
        [(1, i) for i in (*range(5), *range(8, 14))] + [(2, i) for i in range(5)])
    assert read.value == len(rows)


def test_nearby_addresses_shuffle_once(spark):
    rows = [(1, i, "a b", f"{n} Oak st") for i, n in enumerate([5, 5, 12, 40, 51])] + [(1, 9, "a b", "7 Elm st")]
    lines = spark.createDataFrame(rows, "project_id long, line_number int, raw_name string, raw_address string")
    near = sheet_rules.address_rules(lines).where(F.col("code") == sheet_rules.NEARBY_ADDRESS)
    assert exchanges(near) == 1
    assert {(r.line_number, r.partner_line) for r in near.collect()} == {(0, 2), (1, 2), (2, 0)}


def test_reconcile_stays_in_generated_code(spark):
    fields = ["name", "address", "city", "zip_code"]
    rows = [(1, "Ann  B", "ann b", " 1 Oak", "Oak", "", "", "9", "90001"), (2, "ann marie b", "b Ann", "x", "y", "a\u00a0b", "A b", "", "1")]
    pairs = spark.createDataFrame(rows, "id int, " + ", ".join(f"{s}_{f} string" for f in fields for s in "ab")).select(
        "*", *(F.lit(60).alias(f"{s}_{f}_confidence") for f in fields for s in "ab"))
    out = quality.reconcile(pairs)
    got = [(*(r[f] for f in fields), r.disagreements) for r in out.orderBy("id").collect()]
    assert got == [("Ann  B", "1 Oak", "", "90001", ["address", "city", "zip"]), ("ann marie b", "x", "a\u00a0b", "1", ["name", "address"])]
    assert "lambda" not in plan(out) and not [c for c in out.columns if c.startswith("_")]
