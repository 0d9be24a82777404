"""Tables that are changed batch by batch: rows by key in buckets, changes committed by one file.

A batch rewrites the buckets it touches under ``data/gen=<n>`` and then appends one file to
``commits`` that says which generation each bucket is in. Readers follow the newest commit, so a
write that breaks off leaves the table as it was; the next write of that generation replaces what
it left. Generations that no bucket is in are removed after a commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
COMMIT = "gen long, buckets int, places map<int,long>"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def last_commit(spark: SparkSession, path: str):
    """(gen, buckets, places) of the newest commit, places the generation of each bucket; None before the first."""
    if not _exists(spark, f"{path}/commits"):
        return None
    return spark.read.schema(COMMIT).parquet(f"{path}/commits").orderBy(F.desc("gen")).first()


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, places: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/data/gen={g}/bucket={b}" for b, g in sorted(places.items())]
    return spark.read.parquet(*folders) if folders else None


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest commit; None before the first."""
    last = last_commit(spark, path)
    return _read(spark, path, last["places"]) if last else None


def change(batch: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
           gen: int | None = None, buckets: int = BUCKETS) -> int:
    """Commit ``merge(rows so far of the touched buckets, batch)`` and give the generation.

    ``merge`` may look at rows of equal ``keys`` only. ``gen`` grows with every change, by default by one; one that is
    committed already is passed over, so a batch that comes again changes nothing. ``buckets`` counts for a new table.
    One writer at a time.
    """
    spark = batch.sparkSession
    last = last_commit(spark, path)
    if last and gen is not None and gen <= last["gen"]:
        return last["gen"]
    gen = gen if gen is not None else last["gen"] + 1 if last else 0
    buckets = last["buckets"] if last else buckets
    places = dict(last["places"]) if last else {}
    touched = [r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()]  # at most ``buckets``
    past = _read(spark, path, {b: g for b, g in places.items() if b in touched})
    rows = merge(past, batch).withColumn("bucket", _bucket(keys, buckets))
    # A task a bucket, so that each is one file.
    rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/gen={gen}")
    filled = {b for b in touched if _exists(spark, f"{path}/data/gen={gen}/bucket={b}")}
    places = {b: g for b, g in places.items() if b not in touched} | dict.fromkeys(filled, gen)
    commit(spark, path, gen, buckets, places)
    _remove_unused(spark, path, gen, set(places.values()))
    return gen


def commit(spark: SparkSession, path: str, gen: int, buckets: int, places: dict[int, int]) -> None:
    spark.createDataFrame([(gen, buckets, places)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _remove_unused(spark: SparkSession, path: str, newest: int, used: set[int]) -> None:
    files, at = _folder(spark, f"{path}/data")
    if not files.exists(at):
        return
    for s in files.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("gen=") and int(name[4:]) < newest and int(name[4:]) not in used:
            files.delete(s.getPath(), True)


def replace_groups(group: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that puts the batch's rows of a group in place of all rows the group had."""
    def merge(past: DataFrame | None, batch: DataFrame) -> DataFrame:
        if past is None:
            return batch
        return past.join(batch.select(group).distinct(), group, "left_anti").unionByName(batch)

    return merge
