"""Registered queries against their SQL twins; ROLLBOOK_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("ROLLBOOK_SF", "/root/testdata/sf0.001")
QUICK = ["f2_f5_normalize_lines", "f11_token_sort_ratio", "j1_voter_match", "w8_leader_dedup", "r6_duplicate_address",
         "k5_w7_long_city_run", "p6_approve_all", "w1_leaderboard", "a15_m7_pay_run", "j6_similar_pages", "w10_cluster_rows",
         "st4_clock_shifts"]


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ROLLBOOK_ALL") else QUICK)
def test_query(spark, name):
    ok, message = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["s3_pasted_roll", "s3_pasted_roll_headed"])
def test_pasted_texts_are_bounded(spark, monkeypatch, name):
    from pyspark.sql import functions as F
    from rollbook.sources import roll
    seen, parse = [], roll.parse_pasted_roll
    monkeypatch.setattr(roll, "parse_pasted_roll", lambda texts: (seen.append(texts), parse(texts))[1])
    entry.queries()[name](spark, "/root/testdata/sf0.1")
    longest = seen[0].agg(F.max(F.size(F.split(F.trim("voter_roll_text"), "\n")))).first()[0]
    assert longest <= 102  # a line before the first and a header may be added
