"""Sheet rules, packet state and field checks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from rollbook.functions import values as vl
from rollbook.operators import linkage, packet_rules, quality, sheet_rules
from rollbook.session import cut
from test_linkage import lines


def test_scan_flags_blank_unsigned_and_repeated_lines(spark):
    df = lines(spark, [("Jane Smith", "123 Main St"), ("Jane Smith", "123 Main St"), ("Maria Garcia", "789 Pine Rd"), ("", "")])
    df = df.withColumn("signature_present", F.col("line_number") != 3)
    n = linkage.normalize_lines(df)
    flags = sheet_rules.scan_sheets(n)
    by = {}
    for r in flags.collect():
        by.setdefault(r.line_number, {})[r.code] = r.partner_line
    assert by[1]["duplicate_name"] == 2 and by[2]["duplicate_address"] == 1
    assert set(by[4]) == {"blank_line"} and "no_signature" in by[3]
    s = sheet_rules.scan_summary(n, flags).first()
    assert (s.total_lines, s.blank_lines, s.filled_lines) == (4, 1, 3)


def test_consecutive_numbers_name_the_run(spark):
    rows = [(f"P{i}", f"{100 + i} Main St") for i in (3, 1, 2, 0, 9)]
    flags = sheet_rules.address_rules(lines(spark, rows)).collect()
    runs = {r.line_number: r.shared for r in flags if r.code == "consecutive_addresses"}
    assert runs == {4: "2,3,1", 2: "4,3,1", 3: "4,2,1", 1: "4,2,3"}
    near = {r.line_number: r.partner_line for r in flags if r.code == "nearby_address"}
    assert near[5] == 4 and near[4] == 2


def test_large_vector_groups_take_the_tiled_path(spark):
    rows = [(1, i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "project_id int, line_number int, v array<double>")
    a = sheet_rules.similar_vectors(df, "project_id", "line_number", "v").collect()
    b = sheet_rules.similar_vectors(df, "project_id", "line_number", "v", tile=5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_approve_all_table(spark):
    base = dict(packet_id=1, row_status="new_signature", has_signature=True, ai_verdict="likely_valid", flags_json="[]",
                voter_status="valid", fraud_flags="[]", fraud_score=0, review_decision=None, action=None)
    change = {1: {}, 2: {"has_signature": False}, 3: {"voter_status": "uncertain"},
              4: {"fraud_flags": '["consecutive_addresses"]', "fraud_score": 40}, 5: {"flags_json": '["low_confidence"]'},
              6: {"action": "rejected"}, 7: {"row_status": "already_counted"}, 8: {"flags_json": "not json"}}
    schema = ("packet_id int, line_no int, row_status string, has_signature boolean, ai_verdict string, flags_json string, "
              "voter_status string, fraud_flags string, fraud_score int, review_decision string, action string")
    cols = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({**base, "line_no": n, **c}[k] for k in cols) for n, c in change.items()], schema)
    got = {r.line_no: r.action for r in packet_rules.approve_all(df, 99).collect()}
    assert got == {1: "approved", 2: None, 3: None, 4: None, 5: None, 6: "rejected", 7: None, 8: None}


def test_field_checks(spark):
    rows = [("", "", "", ""), ("Cher", "1 Main St", "LA", "90001"), ("Jane Doe", "Main Street", "LA", "10001"),
            ("Jane Doe", "1 Main St", "LA", "96500"), ("Jane Doe", "123 Oak Ave", "Pasadena", "96100")]
    df = spark.createDataFrame(rows, "name string, address string, city string, zip_code string").coalesce(1)
    got = [r.validation_flags for r in quality.validate_fields(df).collect()]
    assert got == [["name_missing", "address_missing", "city_missing", "zip_missing"], ["name_missing_first_or_last"],
                   ["address_missing_street_number", "zip_invalid_california"], ["zip_invalid_california"], []]


def test_rounding_equals_python(spark):
    xs = [2.675, 0.125, 1.005, -2.675, 0.5, 1.5, 2.5, 1e-9, 12345.685, 33.35]
    df = spark.createDataFrame([(x, round(x, 1), round(x, 2)) for x in xs], "x double, a double, b double")
    assert df.where((vl.round_py(F.col("x"), 1) != F.col("a")) | (vl.round_py(F.col("x"), 2) != F.col("b"))).count() == 0


def test_first_strategy_with_rows_wins_a_page(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id int, v string")
    two = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, v string")
    got = quality.first_strategy(["doc_id"], one, two).collect()
    assert sorted((r.doc_id, r.v, r.strategy) for r in got) == [(1, "a", 1), (1, "b", 1), (2, "y", 2)]


def shuffled(spark, df):
    """Bytes that a run of ``df`` writes to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        found, out = store.stageList(None, False, False, none, None).iterator(), 0
        while found.hasNext():
            out += found.next().shuffleWriteBytes()
        return out

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name", ["extract_by_headers", "extract_by_numbers", "extract_by_bands"])
def test_words_of_a_page_are_shuffled_once(spark, name):
    from rollbook.operators import layout
    seq = F.col("id") % 3000
    text = F.when(seq % 12 == 0, (F.floor(seq / 12) % 8 + 1).cast("string")).otherwise(F.substring(F.md5(F.col("id").cast("string")), 1, 8))
    words = cut(spark.range(30000).select(F.floor(F.col("id") / 3000).alias("doc_id"), seq.cast("int").alias("seq"), text.alias("text"), (seq % 12 * 80).alias("lft"),
                (F.floor(seq / 12) * 180).alias("top"), F.lit(64).alias("width"), F.lit(20).alias("height"), (50 + seq % 50).alias("conf")))
    pages = cut(words.select("doc_id").distinct().withColumn("page_width", F.lit(1000)))
    once = shuffled(spark, words.repartition(4, "doc_id"))
    assert shuffled(spark, getattr(layout, name)(words, pages)) < 1.7 * once
