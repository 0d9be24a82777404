"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected, with another projection and shift for each curve, to a few
dimensions, and put in the order of a Hilbert curve through them. Spark ranges the vectors
along each curve. A query is compared with the vectors in a window around its own place on
every curve; the best of all curves are merged and ranked by exact products.

The window is a share of the curve, so that recall does not depend on the number of
vectors. How wide it must be depends on the data: vectors without structure need a large
share, see README for what was measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workforce import global_rank
from ..session import cut

BITS = 10


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Order along the Hilbert curve of points with integer coordinates below 2^bits (Skilling's transform)."""
    axes = [a.astype(np.int64) for a in places.T]
    for level in range(bits - 1, 0, -1):
        bit, rest = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            on = (axes[i] & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & rest)
            axes[i] ^= swap
            axes[0] ^= np.where(on, rest, swap)
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(axes[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ flip) >> level & 1)
    return key


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def usable(vectors: DataFrame) -> tuple[DataFrame, type]:
    """vec_id, v (binary) and key (a 128-bit hash of v) of the vectors that take part, and v's number type.

    Left out are null, empty and zero vectors, those with a null or non-finite component
    or without id, and those of another length than most have.
    """
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() == "double"
    kind = np.float64 if wide else np.float32
    kept = vectors.select("vec_id", "embedding").where(
        "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)")
    length = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    kept = kept.where(F.size("embedding") == (length[0] if length else 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(np.array(x, kind) + kind(0)).tobytes() for x in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array(raw, pa.binary()), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary())],
                names=["vec_id", "v", "key"])

    return kept.mapInArrow(work, "vec_id long, v binary, key binary"), kind


def distinct_vectors(rows: DataFrame, best: int) -> DataFrame:
    """One row a vector: cid (its smallest id), ids (its best + 1 smallest ids) and v.

    Ties go to the smaller id, so no more of a vector's ids can be among the best. Each
    batch keeps that many of a vector before anything is shuffled.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for key, i in zip(batch.column("key").to_pylist(), range(batch.num_rows), strict=True):
                found.setdefault(key, []).append(i)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), batch.column("v").take(pa.array([i[0] for i in found.values()], pa.int64())),
                 pa.array([np.unique(ids[i])[:best + 1] for i in found.values()], pa.list_(pa.int64()))], names=["key", "v", "ids"])

    parts = rows.select("vec_id", "v", "key").mapInArrow(work, "key binary, v binary, ids array<long>")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, best + 1)
    return parts.groupBy("key").agg(F.first("v").alias("v"), merged.alias("ids")).withColumn("cid", F.col("ids")[0])


def along_curves(vectors: DataFrame, kind: type, curves: int, dims: int, seed: int = 3) -> DataFrame:
    """cid, curve, rank: the place of every vector on each curve, from 0."""
    def directions(width: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0] for _ in range(curves)], axis=1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), kind).astype(float)
                y = x @ directions(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([y.sum(0)]), pa.array([(y ** 2).sum(0)])], names=["n", "s", "q"])

    each = vectors.select("v").mapInArrow(moments, "n long, s array<double>, q array<double>")
    total = each.select("n", F.posexplode(F.arrays_zip("s", "q"))).groupBy("pos").agg(
        F.sum("n"), F.sum("col.s"), F.sum("col.q")).orderBy("pos").collect()
    n, s, q = (np.array([float(r[i]) for r in total]) for i in (1, 2, 3))
    mean = s / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean ** 2, 1e-30))
    shift = np.random.default_rng(seed + 1).random(len(mean))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), kind).astype(float)
                z = (x @ directions(x.shape[1]) - mean) / spread
                even = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution's own, so that cells fill evenly
                cell = np.minimum((even + shift) * (1 << BITS - 1), (1 << BITS) - 1).astype(np.int64).reshape(len(x), curves, -1)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert(cell[:, c], BITS))],
                                                     names=["cid", "curve", "h"])

    found = vectors.select("cid", "v").mapInArrow(keys, "cid long, curve int, h long")
    size = vectors.count()
    ranked = global_rank(found, [F.col("curve"), F.col("h"), F.col("cid")])
    return ranked.select("cid", "curve", (F.col("rank") - 1 - F.col("curve") * F.lit(size)).cast("long").alias("rank"))


def search(vectors: DataFrame, every: int = 20, best: int = 20, curves: int = 10, dims: int = 6, window: float = 0.1,
           block: int = 4096, queries_a_task: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``best`` nearest found of each vector whose id is divisible by ``every``.

    Nearness is the inner product in double precision. On each curve a query meets the
    vectors of its block and of the blocks up to ``window`` of the curve away on either
    side. Equal vectors are searched once, however many there are; ties go to the smaller
    id. A group of the search holds at most ``block`` vectors and about
    ``queries_a_task`` queries.

    Unusable vectors (see ``usable``) neither ask nor answer. Repeated rows count once.
    An empty table gives no rows; other columns are ignored.
    """
    rows, kind = usable(vectors)
    rows = cut(rows)
    known = cut(distinct_vectors(rows, best))
    n = known.count()
    per = min(block, max(64, -(-n // 20)))
    reach = int(np.ceil(window * n / per))
    last = max(0, -(-n // per) - 1)
    places = cut(along_curves(known, kind, curves, dims).withColumn("block", F.floor(F.col("rank") / per).cast("long")).join(known.select("cid", "v"), "cid"))
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "key").distinct().join(known.select("key", "cid"), "key").select("vec_id", "cid")
    asking = cut(asking)
    asked = places.join(asking.select("cid").distinct(), "cid", "left_semi")
    parts = max(1, -(-asking.count() * (2 * reach + 1) // max(1, last + 1) // queries_a_task))
    part = F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int")
    left = asked.withColumn("part", part).withColumn("block", F.explode(F.sequence(
        F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(last)))))
    left = left.toDF(*(f"q_{c}" for c in left.columns))
    right = places.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(asked: pa.Table, here: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not here.num_rows:
            return schema.empty_table()
        x = _matrix(asked.column("q_v").combine_chunks(), kind).astype(float)
        y = _matrix(here.column("v").combine_chunks(), kind).astype(float)
        cid = here.column("cid").to_numpy()
        order = np.argsort(cid, kind="stable")
        y, cid = y[order], cid[order]
        top = min(best + 1, len(y))
        out = []
        for i in range(0, len(x), 256):
            product = x[i:i + 256] @ y.T
            pick = np.argsort(-product, axis=1, kind="stable")[:, :top]
            exact = (x[i:i + 256, None, :] * y[pick]).sum(2)  # one order of summation, whatever the block
            out.append((pick, exact))
        pick, exact = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"query": np.repeat(asked.column("q_cid").to_numpy(), top), "cid": cid[pick].ravel(), "score": exact.ravel()}, schema=schema)

    group = ["curve", "block", "part"]
    met = left.groupBy(*(f"q_{c}" for c in group)).cogroup(right.groupBy(*group)).applyInArrow(meet, "query long, cid long, score double")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    found = met.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= best + 1)
    ids = cut(found.join(known.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id")))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = ids.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= best + 1)
    answers = asking.withColumnRenamed("vec_id", "query_id").join(lists.withColumnRenamed("query", "cid"), "cid").where("vec_id != query_id")
    by = Window.partitionBy("query_id").orderBy("r")
    return answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")
