"""Substring deduplication: MinHash banding of paragraphs, and of passages inside longer ones.

A paragraph is a line of at least ``PASSAGE`` words. Lines whose sets of five-word
shingles have a Jaccard similarity of 0.75 or more are found by MinHash: 64 values in 16
bands of 4, so that such a pair collides in some band with a probability of at least
0.9977; pairs that collide are compared exactly. A passage that several documents hold
inside different lines is found as well: each document's words are also cut into
stretches of ``PASSAGE`` words that begin at anchors, the lowest shingle hashes of each
run of ``PASSAGE + 1`` places. Two documents that share 50 words or more share a stretch;
for these the whole set is the one band.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import components, mixed, runs, utf8, word_codes, word_spans
from .overlap import ROUNDS, _must_meet, mixed_lists, trials, verify

PASSAGE, WIDTH = 25, 5
BANDS, ROWS = 16, 4
PEELS = 2  # turns for lines that are in no bucket's largest component
PLACES = 1 << 26  # of the filter of wanted lines, 8 MB
FREQUENT = 1 << 17  # shingles that are ordered by their count: what each task is sent is at most 2 MB
TILE = 1024  # lines on a side of a comparison of a long list
PAIRS = 1 << 18  # pairs of a cell at a time
_rng = np.random.Generator(np.random.PCG64(11))
_SCALE = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_WORD = _rng.integers(0, 1 << 64, PASSAGE, np.uint64) | np.uint64(1)


class Part:
    """The words, shingles and lines of a range of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, owner = word_spans(data, offsets)
        self.codes = word_codes(data, starts, ends)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.start, self.end = points[starts] - points[offsets[owner]], points[ends] - points[offsets[owner]]
        n = len(self.codes)
        self.shingle = np.zeros(max(0, n - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            self.shingle += self.codes[j:j + len(self.shingle)] * _WORD[j]
        self.shingle = mixed(self.shingle)
        self.docs = np.searchsorted(owner, np.arange(len(offsets)))
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        line = breaks[starts] * (len(offsets) + 1) + owner
        edge = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, n))
        long = size >= PASSAGE
        self.first, self.size, self.doc = edge[long], size[long], owner[edge[long]]

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted sets of shingles of all paragraphs one after the other, where each begins, and their keys."""
        n = self.size - WIDTH + 1
        begin = np.cumsum(n) - n
        line = np.repeat(np.arange(len(n)), n)
        every = self.shingle[np.arange(len(line)) - np.repeat(begin - self.first, n)]
        every = every[np.lexsort((every, line))]
        fresh = np.ones(len(every), bool)
        fresh[1:] = (every[1:] != every[:-1]) | (line[1:] != line[:-1])
        every, line = every[fresh], line[fresh]
        begin = np.searchsorted(line, np.arange(len(n)))
        if not len(n):
            return every, begin, np.zeros(0, np.int64)
        place = mixed((np.arange(len(every)) - begin[line] + 1).astype(np.uint64))
        return every, begin, mixed(np.add.reduceat(every * (place | np.uint64(1)), begin)).astype(np.int64)

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of each stretch that begins at an anchor."""
        docs, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d, (a, b) in enumerate(zip(self.docs[:-1].tolist(), self.docs[1:].tolist(), strict=True)):
            free = b - a - PASSAGE + 1  # places where a stretch can begin
            if free < 1:
                continue
            at = self.shingle[a:a + free]
            if free > PASSAGE + 1:
                low = np.lib.stride_tricks.sliding_window_view(at, PASSAGE + 1).argmin(1)
                anchor = np.unique(low + np.arange(len(low)))
            else:
                anchor = np.array([at.argmin()])
            docs.append(np.full(len(anchor), d))
            firsts.append(anchor + a)
        return np.concatenate(docs), np.concatenate(firsts)

    def stretch_hashes(self) -> np.ndarray:
        n = max(0, len(self.codes) - PASSAGE + 1)
        out = np.zeros(n, np.uint64)
        for j in range(PASSAGE):
            out += self.codes[j:j + n] * _WORD[j]
        return mixed(out)


def _signatures(every: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band keys of each set."""
    if not len(first):
        return np.zeros((0, BANDS), np.uint64)
    low = [np.minimum.reduceat(every * a + b, first) for a, b in zip(_SCALE, _SHIFT, strict=True)]
    keys = [mixed(sum((low[band * ROWS + r] * _WORD[r] for r in range(ROWS)), np.uint64(band))) for band in range(BANDS)]
    return np.column_stack(keys)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, end (code points) and words of all paragraphs and stretches; n and bands of the paragraphs only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in runs(offsets):
                part = Part(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                every, begin, keys = part.sets()
                bands = _signatures(every, begin)
                docs, firsts = part.stretches()
                doc, first = np.concatenate((part.doc, docs)), np.concatenate((part.first, firsts))
                words = np.concatenate((part.size, np.full(len(docs), PASSAGE)))
                keys = np.concatenate((keys, part.stretch_hashes().astype(np.int64)[firsts]))
                none = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + doc)), pa.array(keys), pa.array(part.start[first]),
                     pa.array(part.end[first + words - 1]), pa.array(words),
                     pa.array([*np.diff(np.append(begin, len(every))).tolist(), *[None] * none], pa.int64()),
                     pa.array([x.tobytes() for x in bands] + [None] * none, pa.binary())],
                    names=["doc_id", "key", "start", "end", "words", "n", "bands"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, key long, start long, end long, words long, n long, bands binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, shingles of the wanted lines: a filter of fixed size lets them and few others pass."""
    place = F.pmod("key", F.lit(PLACES))
    bits = np.zeros(PLACES // 8, np.uint8)
    for at, piece in wanted.select(place.alias("p")).groupBy(F.expr(f"p div {1 << 15}")).agg(
            F.bitmap_construct_agg(F.expr(f"p % {1 << 15}"))).collect():
        bits[at << 12:(at + 1) << 12] = np.frombuffer(bytes(piece), np.uint8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in runs(offsets):
                every, begin, own = Part(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]).sets()
                ends, p = np.append(begin, len(every))[1:], own % PLACES
                keys, found = [], []
                for i in np.flatnonzero(bits[p >> 3] >> (p & 7) & 1).tolist():
                    if (key := int(own[i])) not in seen:
                        seen.add(key)
                        keys.append(key)
                        found.append(every[begin[i]:ends[i]].tobytes())
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["key", "shingles"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(work, "key long, shingles binary").join(
        wanted, "key", "left_semi").dropDuplicates(["key"])


def across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of the lines of ``open_``, of different roots, that can have a similarity of 0.75.

    Shingles are put in one order, rare before frequent. Of its n a line enters the first
    n - ceil(0.75 n) + 1 into lists. Two similar lines have ceil(3/7 (x + y)) shingles in
    common, so they meet in as many lists as that leaves outside neither's last ones. Lists
    are compared in cells of about ``TILE`` by ``TILE`` lines, where a line brings all it
    has entered: a pair is counted at once and told in the first list that both are in, so
    what meets too seldom is never a row. The comparisons still grow with the square of a list.
    """
    chosen = cut(sets.join(open_.select("k", "n", "root").distinct(), "k"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, times = np.unique(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(times)], names=["s", "df"])

    counts = cut(chosen.select("shingles").mapInArrow(count, "s long, df long").groupBy("s").agg(F.sum("df").alias("df")).where("df > 1"))
    level = F.floor(F.log2("df") * 8)
    above, least = 0, 1 << 30
    for step, n in sorted(counts.groupBy(level).count().collect(), reverse=True):
        above += n
        if above > FREQUENT:
            break
        least = step
    table = counts.where(level >= least).orderBy("s").toArrow()
    marks, df = table.column("s").to_numpy(), table.column("df").to_numpy()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for s in batch.column("shingles").to_pylist():
                s = np.frombuffer(s, np.int64)
                at = np.minimum(np.searchsorted(marks, s), len(marks) - 1)
                weight = np.where(marks[at] == s, df[at], 0) if len(marks) else np.zeros(len(s), np.int64)
                picked.append(np.sort(s[np.lexsort((s, weight))[:len(s) // 4 + 1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "n", "root")), pa.array(picked, pa.list_(pa.int64()))],
                                             names=["k", "n", "root", "entered"])

    lines = cut(chosen.mapInArrow(enter, "k long, n long, root long, entered array<long>"))
    lists = lines.select("k", "root", F.explode("entered").alias("s"))
    sizes = lists.groupBy("s", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(
        F.max_by("root", F.struct("m", "root")).alias("hub"), F.sum("m").alias("c"), F.max("m").alias("m")).where("c > m")
    # Of two components one is not the list's largest; both sides of a long list are dealt out to tiles.
    told = lists.drop("root").join(sizes.select("s", "hub", F.expr(f"(c - m) div {TILE} + 1").alias("high"), F.expr(f"c div {TILE} + 1").alias("wide")), "s")
    told = cut(told.join(lines, "k"))
    tile = lambda n: F.pmod(F.xxhash64("k"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row = ("k", "n", "root", (F.col("root") == F.col("hub")).alias("inner"), "entered")
    out = told.where("root != hub").select("s", tile("high").alias("i"), every("wide").alias("j"), F.lit(False).alias("met"), *row)
    met = told.select("s", every("high").alias("i"), tile("wide").alias("j"), F.lit(True).alias("met"), *row)
    cells = out.union(met).repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "met")
    return cells.mapInArrow(_meetings, "a long, b long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs in cells, from rows sorted by cell and then side; a cell may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            held.append(batch)
            s, i, j = (batch.column(c).to_numpy() for c in "sij")
            edge = np.flatnonzero((np.diff(s) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))
            if not len(edge) and len(held) > 1 and all(held[-2].column(c)[-1] == batch.column(c)[0] for c in "sij"):
                continue
            # The last cell may go on.
            last = int(edge[-1]) + 1 if len(edge) else 0
            rows = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held:
            rows, held = pa.Table.from_batches(held), []
        else:
            return
        if rows.num_rows:
            yield from _met(rows.combine_chunks())


def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs in some whole cells."""
    s, i, j, k, n, root = (rows.column(c).to_numpy() for c in ("s", "i", "j", "k", "n", "root"))
    met, inner = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("met", "inner"))
    entered = rows.column("entered").combine_chunks()
    size = entered.value_lengths().to_numpy().astype(np.int64)
    values, code = np.unique(entered.flatten().to_numpy(), return_inverse=True)
    start = np.cumsum(size) - size
    have = np.repeat(np.arange(len(s)), size) * len(values) + code  # sorted: rows in order, each with its shingles in order
    cell = np.cumsum(np.concatenate(([0], (np.diff(s) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))))
    own = np.flatnonzero(~met)
    low, high = np.searchsorted(cell * 2 + met, cell[own] * 2 + 1), np.searchsorted(cell * 2 + met, cell[own] * 2 + 1, "right")
    own, low, wide = own[high > low], low[high > low], (high - low)[high > low]
    ends = np.cumsum(wide)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - wide[at] + PAIRS, "right")))
        w = wide[at:to]
        x = np.repeat(own[at:to], w)
        y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[at:to], w)
        at = to
        fits = (root[x] != root[y]) & (inner[y] | (k[x] < k[y])) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
        x, y = x[fits], y[fits]
        for first in range(0, len(x), PAIRS // 16):
            a, b = x[first:first + PAIRS // 16], y[first:first + PAIRS // 16]
            begin = np.cumsum(size[a]) - size[a]
            mine = code[np.arange(size[a].sum()) - np.repeat(begin - start[a], size[a])]
            want = np.repeat(b, size[a]) * len(values) + mine
            hit = have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want
            common = np.add.reduceat(hit, begin, dtype=np.int64)
            lowest = np.minimum.reduceat(np.where(hit, mine, len(values)), begin)
            good = (common >= _must_meet(n[a], n[b])) & (values[np.minimum(lowest, len(values) - 1)] == s[a])
            a, b = k[a[good]], k[b[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def similar_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, root) of the components of similar lines, from (key, n, bands) of distinct lines.

    Lines that collide in a band are compared with one of the band's bucket, then with
    some of a bucket's largest component, several times by turns, a line in one of its
    buckets a turn; what is still apart is treated so among itself. That joins near copies
    of one text without looking at their pairs. Then the lines of buckets that still hold
    several components are compared across components, without a bound: ``across``.
    """
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(bands, 8 * i + 1, 8), i))")
    long = lines.select(F.col("key").alias("k"), "n", F.explode(band).alias("t"))
    lead = long.groupBy("t").agg(F.min("k").alias("lead"), F.min_by("n", "k").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    long = cut(long.join(lead, "t"))
    sets = cut(_sets(docs, long.select(F.col("k").alias("key")).distinct()).withColumnRenamed("key", "k"))
    fits = lambda x, y: (4 * F.col(x) >= 3 * F.col(y)) & (4 * F.col(y) >= 3 * F.col(x))
    star = long.where((F.col("k") != F.col("lead")) & fits("n", "m")).select(F.col("lead").alias("a"), F.col("k").alias("b")).distinct()
    comps = components(verify(star, sets), "a", "b")
    long = long.drop("lead", "m")
    known = lambda: comps.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for turn in range(ROUNDS):
        open_ = mixed_lists(long, comps)
        if open_.isEmpty():
            return comps
        comps = components(known().union(verify(trials(open_, turn), sets)), "a", "b")
    rest = mixed_lists(long, comps)
    for turn in range(PEELS):
        # What no trial has joined to a bucket's largest component meets among itself.
        sizes = rest.groupBy("t", "root").agg(F.count(F.lit(1)).alias("m"))
        hubs = sizes.groupBy("t").agg(F.max_by("root", F.struct("m", "root")).alias("hub"))
        rest = mixed_lists(rest.join(hubs, "t").where("root != hub").drop("hub", "root"), comps)
        if rest.isEmpty():
            break
        comps = components(known().union(verify(trials(rest, ROUNDS + turn), sets)), "a", "b")
    open_ = mixed_lists(long, comps)
    if open_.isEmpty():
        return comps
    return components(known().union(verify(across(open_, sets), sets)), "a", "b")


def repeats(docs: DataFrame) -> DataFrame:
    """The passages that come in two documents or more: doc_id, start, end, words, component_id, n_copies, removed.

    Paragraphs and stretches that are similar or equal are one class. One of a class that
    also stands in an earlier document is to go, the others are first copies. Overlapping
    ones of a document are put together, those to go and first copies apart, so a passage
    with ``removed`` holds nothing but what earlier documents have, and may lie in a first
    copy. component_id is the smallest doc_id of the classes in a passage; n_copies is how
    often its most common class comes. start and end are code
    points, end exclusive; words is the length of the longest unit in it.

    Null and empty texts, and texts of fewer words than a passage, have none. Rows
    without doc_id are left out; rows of one doc_id are one document. An empty table gives
    no rows; other columns are ignored.
    """
    found = cut(units(docs))
    lines = found.where("bands IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    comps = similar_lines(docs, lines).withColumnRenamed("node", "key")
    narrow = found.select("doc_id", F.when(F.col("bands").isNull(), F.col("key")).alias("stretch"),
                          F.when(F.col("bands").isNotNull(), F.col("key")).alias("key"), "start", "end", "words")
    whole = narrow.where("key IS NOT NULL").join(comps, "key", "left").select("doc_id", F.coalesce("root", "key").alias("class"), "start", "end", "words")
    every = whole.union(narrow.where("stretch IS NOT NULL").select("doc_id", "stretch", "start", "end", "words"))
    kinds = every.groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    hit = every.join(kinds.drop("high"), "class")
    hit = hit.withColumn("removed", F.col("low") < F.col("doc_id"))
    by = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(by)
    islands = hit.withColumn("_reach", reach).withColumn("_island", island).groupBy("doc_id", "removed", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"), F.min("low").alias("component_id"),
        F.max("n").alias("n_copies"))
    # A first copy that lies within what goes is no passage of its own.
    gone = F.max(F.when(F.col("removed"), F.col("end"))).over(Window.partitionBy("doc_id").orderBy("start"))
    return islands.withColumn("_gone", gone).where("removed OR _gone IS NULL OR _gone < end").select(
        "doc_id", "start", "end", "words", "component_id", "n_copies", "removed")
