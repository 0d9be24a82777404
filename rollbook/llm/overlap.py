"""Jaccard join of documents on word shingles by T-occurrence search over inverted lists.

Two documents with sets of x and y shingles link when 100 * common >= 75 * union, hence
when they have at least T = 3/7 (x + y) shingles in common. Shingles are put in one order
for all documents, rare before frequent. Of its set a document enters only the first
x - ceil(0.75 x) + 1 into inverted lists: linked documents meet there, and how often they
must meet follows from T. Light shingles have short lists, which are merged for each
document; heavy ones have long lists, which are never merged: candidates are probed for
them by binary search when the whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACES, components, runs, set_aside, shingles, utf8, word_codes, word_spans

HEAVY = 1 << 17  # shingles that may count as heavy: what each task is sent is at most 2 MB
BITS = 1 << 26  # of the filter of wanted documents, 8 MB
BUCKET_SHINGLES = 1 << 20
AT_ONCE = 1 << 20  # shingles that a task holds before it sends rows on
ROUNDS, TRIALS = 3, 8  # of trying documents of a heavy list against the list's largest component


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text of a batch."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, owner = word_spans(part, at)
        yield from enumerate(shingles(word_codes(part, starts, ends), owner, b - a, width), a)


def sets_in_parts(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """The sets of a batch, some at a time: about ``AT_ONCE`` shingles, at least one set."""
    part, held = [], 0
    for _, s in sets_of(column, width):
        part.append(s)
        held += len(s)
        if held >= AT_ONCE:
            yield part
            part, held = [], 0
    if part:
        yield part


def key_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def digests(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n, k: size and key of each document's set; equal sets have equal keys."""
    def work(batches):
        for batch in batches:
            found = [(len(s), key_of(s)) for _, s in sets_of(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([k for _, k in found], pa.int64())], names=["doc_id", "text_hash", "n", "k"])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(work, given.drop("text").schema.add("n", "long").add("k", "long"))


def _split(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the first ``bits`` bits) and the next 32 bits of each hash."""
    top = values >> np.uint64(32 - bits)
    return (top >> np.uint64(32)).astype(np.int64), (top & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bucket and range of each run of a sorted array."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            yield int(bucket[a]), slice(a, b)


def heavy_shingles(docs: DataFrame, width: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``most`` most frequent shingles, as sorted (bucket, hash) marks, and their counts.

    Every shingle of every document is counted. A task sums up first what it holds and
    sends, by bucket, those it holds once apart from those it holds more often.
    """
    def count(batches):
        for found in (part for batch in batches for part in sets_in_parts(batch.column("text"), width)):
            every, times = np.unique(np.concatenate(found), return_counts=True)
            bucket, mark = _split(every, bits)
            rows = [(b, mark[s][times[s] == 1].tobytes(), mark[s][times[s] > 1].tobytes(),
                     times[s][times[s] > 1].astype(np.uint32).tobytes()) for b, s in _by_bucket(bucket)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("bucket", "once", "often", "times"), r, strict=True)) for r in rows],
                pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("often", pa.binary()), ("times", pa.binary())]))

    def total(table: pa.Table) -> pa.Table:
        once, often, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("once", "often", "times"))
        marks = np.sort(once)
        first = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(marks)])))
        repeated = size >= 4
        every = np.concatenate((marks[first][repeated], often))
        weight = np.concatenate((size[repeated], times.astype(np.int64)))
        every, where = np.unique(every, return_inverse=True)
        weight = np.bincount(where, weight, len(every)).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"mark": (np.int64(bucket) << 32) | every.astype(np.int64), "df": weight})

    counts = cut(docs.select("text").mapInArrow(count, "bucket long, once binary, often binary, times binary")
                 .groupBy("bucket").applyInArrow(total, "mark long, df long").where("df >= 4"))
    level = F.floor(F.log2("df") * 8)
    above, least = 0, None
    for step, n in sorted(counts.groupBy(level).count().collect(), reverse=True):
        above += n
        if above > most:
            break
        least = step
    table = counts.where(level >= (least if least is not None else 1 << 30)).orderBy("mark").toArrow()
    return table.column("mark").to_numpy(), table.column("df").to_numpy()


def _enter(n: int) -> int:
    """How many of its n shingles a document enters into lists."""
    return n - -(-3 * n // 4) + 1


def _must_meet(x: np.ndarray | int, y: np.ndarray | int):
    """How many entered shingles two linked documents have in common at least."""
    return -(-3 * (x + y) // 7) - np.maximum(-(-3 * x // 4), -(-3 * y // 4)) + 1


def postings(docs: DataFrame, width: int, bits: int, marks: np.ndarray, df: np.ndarray) -> DataFrame:
    """By bucket the entered light shingles (heavy false) and heavy ones with the key and size of their set.

    ``deep`` of a light shingle is the number of heavy ones that the document entered, of a
    heavy one its place in the document's own order. Heavy ones are dealt out by ``part`` too, so that no group grows with a frequent shingle. A set that
    a worker has just seen is not sent again.
    """
    def work(batches):
        seen: set[int] = set()
        for found in (part for batch in batches for part in sets_in_parts(batch.column("text"), width)):
            parts = []
            for s in found:
                key = key_of(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                bucket, mark = _split(s, bits)
                full = (bucket << 32) | mark.astype(np.int64)
                at = np.minimum(np.searchsorted(marks, full), len(marks) - 1)
                weight = np.where(marks[at] == full, df[at], 0) if len(marks) else np.zeros(len(s), np.int64)
                light, enter = np.flatnonzero(weight == 0), _enter(len(s))
                chosen = light[:enter]
                if len(chosen) < enter:
                    rest = np.flatnonzero(weight)
                    chosen = np.concatenate((chosen, rest[np.lexsort((full[rest], weight[rest]))][:enter - len(chosen)]))
                deep = int((weight[chosen] > 0).sum())
                place = np.arange(enter) if deep else np.zeros(enter, np.int64)
                parts.append((full[chosen], weight[chosen] > 0, np.full(enter, key, np.int64), np.full(enter, len(s), np.uint32),
                              np.where(weight[chosen] > 0, place, deep).astype(np.uint32)))
            if len(seen) > 500_000:
                seen.clear()
            if not parts:
                continue
            full, heavy, key, n, deep = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = []
            for which in (False, True):
                pick = np.flatnonzero(heavy == which)
                pick = pick[np.argsort(full[pick] >> 32, kind="stable")]
                for b, s in _by_bucket(full[pick] >> 32):
                    i = pick[s]
                    part = int(key[i[0]] % 1024) if which else 0
                    rows.append((b, which, part, (full[i] & 0xFFFFFFFF).astype(np.uint32).tobytes(), key[i].tobytes(),
                                 n[i].tobytes(), deep[i].tobytes() if deep[i].any() else b""))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("bucket", "heavy", "part", "mark", "k", "n", "deep"), r, strict=True)) for r in rows],
                pa.schema([("bucket", pa.int64()), ("heavy", pa.bool_()), ("part", pa.int64()), *((c, pa.binary()) for c in ("mark", "k", "n", "deep"))]))

    return docs.select("text").mapInArrow(work, "bucket long, heavy boolean, part long, mark binary, k binary, n binary, deep binary")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    mark, k, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("mark", np.uint32), ("k", np.int64), ("n", np.uint32)))
    deep = np.concatenate([np.frombuffer(d, np.uint32) if d else np.zeros(len(m) // 4, np.uint32) for d, m in zip(
        table.column("deep").to_pylist(), table.column("mark").to_pylist(), strict=True)])
    return mark, k, n.astype(np.int64), deep


def short_lists(table: pa.Table) -> pa.Table:
    """Of one bucket: for each document (x) its lists, cut to later documents of a fitting size.

    Lists are in the order of (size, key); light lists are short by the count of their
    shingle. A row has a document's lists one after the other and the length of each.
    """
    mark, k, n, deep = _unpacked(table)
    if table.column("heavy")[0].as_py():
        token = (np.int64(table.column("bucket")[0].as_py()) << 32) | mark.astype(np.int64)
        none = pa.nulls(len(mark), pa.binary())
        return pa.table({"heavy": np.ones(len(mark), bool), "x": token, "k": k, "nx": n, "deep": deep.astype(np.int64),
                         "lengths": none, "ks": none, "ns": none})
    order = np.lexsort((k, n, mark))
    mark, k, n, deep = mark[order], k[order], n[order], deep[order]
    fresh = np.concatenate(([True], (mark[1:] != mark[:-1]) | (k[1:] != k[:-1])))
    mark, k, n, deep = mark[fresh], k[fresh], n[fresh], deep[fresh]
    first = np.concatenate(([True], mark[1:] != mark[:-1]))
    end = np.append(np.flatnonzero(first)[1:], len(mark))[np.cumsum(first) - 1]
    index = np.arange(len(mark))
    size = end - index - 1
    owner = np.repeat(index, size)
    other = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + owner + 1
    fits = 4 * n[owner] >= 3 * n[other]
    owner, other = owner[fits], other[fits]
    by = np.lexsort((other, owner, k[owner]))
    owner, other = owner[by], other[by]
    rows = []
    for _, s in _by_bucket(np.unique(k[owner], return_inverse=True)[1]):
        mine = owner[s]
        lengths = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)])))
        rows.append((k[mine[0]], n[mine[0]], deep[mine[0]], lengths.astype(np.uint32).tobytes(),
                     k[other[s]].tobytes(), n[other[s]].astype(np.uint32).tobytes()))
    columns = [[False] * len(rows), *(list(zip(*rows, strict=True)) or [[]] * 6)]
    columns.insert(2, columns[1])
    kinds = [pa.bool_()] + [pa.int64()] * 4 + [pa.binary()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["heavy", "x", "k", "nx", "deep", "lengths", "ks", "ns"])


LISTS = "heavy boolean, x long, k long, nx long, deep long, lengths binary, ks binary, ns binary"


def search(lists: list[list[tuple[int, int]]], need: int) -> list[tuple[tuple[int, int], int]]:
    """DivideSkip: the entries that come in at least ``need`` of the sorted lists, with how often.

    The longest lists are set aside; an entry that is to come ``need`` times must come
    ``need`` less their number times in the others, which are merged by a heap. What
    passes is looked up in the long lists by binary search.
    """
    lists = sorted(lists, key=len)
    long = min(need - 1, int(need / (0.01 * log2(max(2, len(lists[-1]))) + 1)), len(lists) - 1)
    apart = lists[len(lists) - long:]
    probes = [np.array([e[1] for e in x]) for x in apart]
    sorters = [np.argsort(p) for p in probes]
    out = []
    for entry, same in groupby(merge(*lists[:len(lists) - long])):
        times = sum(1 for _ in same)
        if times < need - long:
            continue
        for p, s in zip(probes, sorters, strict=True):
            at = np.searchsorted(p, entry[1], sorter=s)
            times += bool(at < len(p) and p[s[at]] == entry[1])
        if times >= need:
            out.append((entry, times))
    return out


def candidates(lists: DataFrame) -> DataFrame:
    """a, b, c: pairs that meet often enough in light lists, and how often."""
    def work(batches):
        x, table = None, []

        def settle():
            every = [e for row in table for e in row[2]]
            nx, deep = table[0][0], table[0][1]
            sizes = np.array([n for part in every for n, _ in part])
            need = max(1, int(_must_meet(nx, sizes).min()) - deep)
            if len(every) < need:
                return []
            return [(k, c) for (n, k), c in search(every, need) if c >= max(1, int(_must_meet(nx, n)) - deep)]

        def told(found, mine):
            return [{"a": mine, "b": k, "c": c} for k, c in found]

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["x"] != x:
                    out += told(settle(), x) if table else []
                    x, table = row["x"], []
                ks, ns = np.frombuffer(row["ks"], np.int64).tolist(), np.frombuffer(row["ns"], np.uint32).tolist()
                parts, at = [], 0
                for length in np.frombuffer(row["lengths"], np.uint32).tolist():
                    parts.append(list(zip(ns[at:at + length], ks[at:at + length], strict=True)))
                    at += length
                table.append((row["nx"], row["deep"], parts))
            yield pa.RecordBatch.from_pylist(out, schema)
        if table:
            yield pa.RecordBatch.from_pylist(told(settle(), x), schema)

    return lists.repartition("x").sortWithinPartitions("x").mapInArrow(work, "a long, b long, c long")


def fetch(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """k, n, shingles of the documents whose ids are ``wanted``, of those without id and of some others.

    The ids go into a filter of fixed size, so only texts that pass it are read into
    shingles; what passes by chance drops out at the next join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bits = np.zeros(BITS // 8, np.uint8)
    parts = wanted.where("doc_id IS NOT NULL").select(place.alias("p")).groupBy(F.expr(f"p div {1 << 15}").alias("at")).agg(
        F.bitmap_construct_agg(F.expr(f"p % {1 << 15}")).alias("part"))
    for at, part in parts.collect():
        bits[at << 12:(at + 1) << 12] = np.frombuffer(bytes(part), np.uint8)

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            p = batch.column("p").to_numpy(zero_copy_only=False).astype(np.int64)
            passed = np.flatnonzero((p < 0) | (bits[p >> 3] >> (p & 7) & 1).astype(bool))
            keys, sizes, parts = [], [], []
            for _, s in sets_of(batch.column("text").take(pa.array(passed)), width):
                key = key_of(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    parts.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())],
                                             names=["k", "n", "shingles"])
            if len(seen) > 500_000:
                seen.clear()

    given = docs.select("text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place).cast("long").alias("p"))
    return given.mapInArrow(work, "k long, n long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link: the smaller set is looked up in the larger by binary search."""
    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    left, right = (comps.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
    return pairs.join(left, "a", "left").join(right, "b", "left").where(
        F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(pairs.columns)


def mixed_lists(long: DataFrame, comps: DataFrame) -> DataFrame:
    """The lists (t) that still hold several components, with the root of each set (k)."""
    named = long.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    mixed = named.groupBy("t").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("t")
    return cut(named.join(mixed, "t", "left_semi"))


def trials(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs of each document outside a list's largest component with about ``TRIALS`` documents inside.

    A document takes the list with the largest such component. Members are dealt out to
    buckets by hash, another way each turn, and a document meets one bucket, so pairs grow
    with the documents and no list is a group of its own.
    """
    sizes = open_.groupBy("t", "root").agg(F.count(F.lit(1)).alias("m"))
    hubs = sizes.groupBy("t").agg(F.max_by(F.struct("root", "m"), F.struct("m", "root")).alias("hub"))
    told = open_.join(hubs, "t").select("t", "k", "n", "root", F.col("hub.root").alias("hub"), F.greatest(
        F.col("hub.m") / TRIALS, F.lit(1)).cast("long").alias("buckets"))
    bucket = lambda salt: F.pmod(F.xxhash64("k", F.lit(salt)), F.col("buckets"))
    outside = told.where("root != hub").groupBy("k", "n").agg(F.max_by(F.struct("t", "buckets"), F.struct("buckets", "t")).alias("x")).select(
        "k", "n", "x.*").select("t", bucket(2 * turn).alias("bucket"), F.col("k").alias("ka"), F.col("n").alias("na"))
    inside = told.where("root = hub").select("t", bucket(2 * turn + 1).alias("bucket"), F.col("k").alias("kb"), F.col("n").alias("nb"))
    met = outside.join(inside, ["t", "bucket"]).where("4 * na >= 3 * nb AND 4 * nb >= 3 * na")
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def links(docs: DataFrame, found: DataFrame, width: int = 5, heavy: int = HEAVY) -> DataFrame:
    """(node, root) over the keys of sets: the components of all links between different sets.

    Candidates of light lists come from ``search``. A heavy list is first compared with
    one of its documents only, then what that left out with some documents of the list's
    largest component, which together join near copies of one text without looking at
    their pairs; then heavy lists that still hold several components are joined with
    themselves, across components only and only where the shingle can be the first that
    two linked documents have in common. Of the candidates, each document's best one is
    compared first and the others only where that has not joined the two.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    bits = min(24, max(8, int(total // BUCKET_SHINGLES).bit_length()))
    marks, df = heavy_shingles(docs, width, bits, heavy)
    lists = cut(postings(docs, width, bits, marks, df).groupBy("bucket", "heavy", "part").applyInArrow(short_lists, LISTS))
    long = cut(lists.where("heavy").select(F.col("x").alias("t"), "k", F.col("nx").alias("n"), F.col("deep").alias("place")).distinct())
    lead = long.groupBy("t").agg(F.min_by("n", "k").alias("m"), F.min("k").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = long.join(lead.drop("size"), "t").where("k != lead AND 4 * n >= 3 * m AND 4 * m >= 3 * n").groupBy(
        F.col("lead").alias("a"), F.col("k").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    pairs = cut(candidates(lists.where("NOT heavy")).union(star))
    # Every set that may be compared: those in a pair and those in a heavy list.
    nodes = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(long.join(lead, "t", "left_semi").select("k")).distinct()
    ids = found.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("doc_id")).join(nodes, "k", "left_semi")
    sets = cut(fetch(docs, width, ids).join(nodes, "k", "left_semi").dropDuplicates(["k"]))
    best = pairs.union(pairs.select("b", "a", "c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    sure = cut(verify(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))
    comps = components(sure, "a", "b")
    more = verify(_between(pairs, comps).drop("c").distinct(), sets)
    comps = components(sure.union(more), "a", "b")
    for i in range(ROUNDS):
        open_ = mixed_lists(long, comps)
        if open_.isEmpty():
            return comps
        told = cut(verify(trials(open_, i), sets))
        comps = components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(told), "a", "b")
    open_ = mixed_lists(long, comps)
    one, two = (open_.select("t", *(F.col(c).alias(c + x) for c in ("k", "n", "place", "root"))) for x in "ab")
    # In the common order, the first shingle that both have is followed by enough others in either.
    least = -F.floor(-3 * (F.col("na") + F.col("nb")) / 7)
    last = one.where("7 * placea <= na").join(two, "t").where(
        (F.struct("na", "ka") < F.struct("nb", "kb")) & (F.col("roota") != F.col("rootb")) & (4 * F.col("na") >= 3 * F.col("nb"))
        & (F.col("placea") <= F.col("na") - least) & (F.col("placeb") <= F.col("nb") - least)).select(
        F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()
    return components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verify(last, sets)), "a", "b")


def join(docs: DataFrame, width: int = 5, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, group (its component's key), component_id.

    Words are runs of non-blank characters with A-Z in lower case; a text of fewer than
    ``width`` words is one shingle. component_id is the smallest doc_id that links reach.
    A null or empty text has no shingles and no group, and is linked with nothing.
    Repeated rows and copies have one set, which is searched once. A null id is kept; a
    component's id is the smallest that is not null. An empty table gives no rows. Other
    columns are ignored.
    """
    found = cut(digests(docs, width))
    comps = links(docs, found, width, heavy)
    kinds = found.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("low"))
    rooted = kinds.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("k", F.col("root").alias("group"), "component_id")
    return found.join(named, "k", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("group")).alias("group"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@set_aside
def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, null last.

    Documents without words are in no group and stay. Of repeated rows one stays.
    """
    found = cut(join(docs, width))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = found.where("n_shingles > 0").groupBy("group").agg(F.min(row).alias("m")).select(
        F.col("m.doc_id").alias("_id"), F.col("m.text_hash").alias("_hash"))
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    blank = F.coalesce(F.trim("text", F.lit(SPACES)), F.lit("")) == ""
    kept = hashed.where(~blank).join(chosen, (F.col("_text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy(F.lit(0)))
        kept = kept.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.union(hashed.where(blank)).drop("_text")
