"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from rollbook.sources import files, roll


def registry(spark, tmp_path, parts=3):
    rows = [(f"V{i:04d}", f"Last {i}", "N/A" if i % 9 == 0 else f"First {i}", f'{i} "Main" St, Unit {i}', "") for i in range(400)]
    df = spark.createDataFrame(rows, "voter_id string, last_name string, first_name string, street_address string, city string")
    files.write_csv(df.repartitionByRange(parts, "voter_id").sortWithinPartitions("voter_id"), str(tmp_path / "roll"))
    return str(tmp_path / "roll")


def test_positions_do_not_depend_on_the_split(spark, tmp_path):
    """Three files, read whole and in pieces of 700 bytes: the same rows at the same places."""
    path, found = registry(spark, tmp_path), []
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = roll.read_roll(spark, path)
            found.append((df.rdd.getNumPartitions(), [tuple(r) for r in df.orderBy("roll_pos").collect()]))
            pieces = spark.read.option("header", True).csv(path).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces > 10
    assert found[0][1] == found[1][1]
    assert [(r[0], r[-1]) for r in found[0][1]] == [(f"V{i:04d}", i + 1) for i in range(400)]
    assert found[0][1][9][2] == ""
    assert found[0][1][10][3] == '10 "Main" St, Unit 10'


def test_a_registry_without_its_columns(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a", "b")], "voter_id string, name string"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="first_name"):
        roll.read_roll(spark, str(tmp_path / "bad"))
    assert roll.preview_roll(roll.read_roll(spark, registry(spark, tmp_path)), 3).count() == 3


def test_documents_of_a_folder(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF one"), ("b.PDF", b"%PDF"), ("c.txt", b"no"), ("sub.pdf", b"x" * 50)):
        (tmp_path / name).write_bytes(data)
    docs = files.scan_documents(spark, str(tmp_path))
    admitted, refused = files.split_admitted(files.admit_uploads(docs, max_bytes=40))
    assert sorted((r["filename"], r["suffix"], bytes(r["content"])) for r in admitted.collect()) == [
        ("a.pdf", ".pdf", b"%PDF one"), ("b.PDF", ".pdf", b"%PDF")]
    assert [(r["filename"], r["reject_reason"]) for r in refused.collect()] == [("sub.pdf", "too_large")]


def test_tables_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'say "hi"', 2.5)], "id long, t string, x double")
    df.write.parquet(str(tmp_path / "things"))
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path), "things").collect())) == [(1, "a,b", None), (2, 'say "hi"', 2.5)]
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).exceptAll(df).count() == 0
    files.write_csv(df, str(tmp_path / "csv"), by="id")
    back = spark.read.option("header", True).option("escape", '"').schema("t string, x double, id long").csv(str(tmp_path / "csv"))
    assert sorted((r["id"], r["t"], r["x"]) for r in back.collect()) == [(1, "a,b", None), (2, 'say "hi"', 2.5)]
    said = files.result_json(df, ["id"]).where(F.col("id") == 1).first()["json"]
    assert said == '{"id":1,"t":"a,b","x":null}'
