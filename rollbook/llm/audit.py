"""Source divergence audit by chunk factorization.

Texts are only cut at white space; what the chunks consist of is worked out once for each
distinct chunk of the corpus and joined back to where the chunk stands.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_CHUNKS = 3_000_000  # (document, chunk) pairs of a block of documents
ROW_CHUNKS = 100_000  # ... and of a row of them
BATCH = 50_000
STRIPE = 256  # sources compared with all others at a time
CELLS = 2_000_000  # numbers of a matrix in a task
HELD = 250_000  # counts held at once besides the sums
COUNTS = ["lang", "source", "term", "documents", "occurrences"]
FACTORS = "block long, chunk string, number int, lang string, source string, sizes binary, chunks binary, counts binary"


def squeezed(numbers: np.ndarray) -> bytes:
    """Small integers, compressed."""
    return pa.compress(numbers.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def stretched(data: bytes) -> np.ndarray:
    with pa.input_stream(pa.BufferReader(data), compression="zstd") as stream:
        return np.frombuffer(stream.read(), np.int32).astype(np.int64)


class Block:
    """Some consecutive documents of a task as numbers of chunks, and the chunks in the order of first use."""

    def __init__(self, number: int):
        self.number = number
        self.numbers: dict[bytes, int] = {}
        self.rows: dict[tuple[str, str], list[array]] = {}  # of each source: chunks of each document, their numbers, counts
        self.pairs = 0

    def add(self, lang: str, source: str, text: str) -> Iterator[pa.RecordBatch]:
        """Takes a document in; gives rows that are full."""
        if not (own := Counter(text.encode().split())):  # bytes.split() cuts at \x20 and \x09-\x0D
            return
        if (lang, source) not in self.rows:
            self.rows[lang, source] = [array("i"), array("i"), array("i")]
        numbers, (sizes, chunks, counts) = self.numbers, self.rows[lang, source]
        sizes.append(len(own))
        chunks.extend([numbers.setdefault(c, len(numbers)) for c in own])
        counts.extend(own.values())
        self.pairs += len(own)
        if len(chunks) >= ROW_CHUNKS:
            yield self.batch([(lang, source, *self.rows.pop((lang, source)))])

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        """Rows with their chunks in order within a document, each as the step from the one before."""
        found: list[list[bytes]] = [[], [], []]
        for r in rows:
            sizes, chunks, counts = (np.frombuffer(x, np.int32) for x in r[2:])
            order = np.lexsort((chunks, np.repeat(np.arange(len(sizes)), sizes)))
            steps = np.diff(chunks[order], prepend=0)
            firsts = sizes.cumsum()[:-1]
            steps[firsts] = chunks[order][firsts]
            for own, x in zip(found, (sizes, steps, counts[order]), strict=True):
                own.append(squeezed(x))
        lists = dict(zip(("sizes", "chunks", "counts"), (pa.array(x, pa.binary()) for x in found), strict=True))
        return self.of(len(rows), lang=pa.array([r[0] for r in rows]), source=pa.array([r[1] for r in rows]), **lists)

    def of(self, size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"chunk": pa.string(), "number": pa.int32(), "lang": pa.string(), "source": pa.string()}
        found = [pa.repeat(pa.scalar(self.number, pa.int64()), size)]
        for name in ("chunk", "number", "lang", "source", "sizes", "chunks", "counts"):
            found.append(columns[name] if name in columns else pa.nulls(size, kinds.get(name, pa.binary())))
        return pa.RecordBatch.from_arrays(found, ["block", "chunk", "number", "lang", "source", "sizes", "chunks", "counts"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for key, row in self.rows.items():
            yield self.batch([(*key, *row)])
        chunks = list(self.numbers)
        for at in range(0, len(chunks), BATCH):
            some = pa.array(chunks[at:at + BATCH], pa.binary()).cast(pa.string())
            yield self.of(len(some), chunk=some, number=pa.array(np.arange(at, at + len(some)), pa.int32()))


def documents_of(sizes: bytes, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes, chunks and counts that ``Block.batch`` has written."""
    found, chunks = stretched(sizes), stretched(steps).cumsum()
    firsts = np.concatenate([[0], found.cumsum()[:-1]])
    before = np.where(firsts > 0, chunks[firsts - 1], 0)
    return found, chunks - np.repeat(before, found), stretched(counts)


def factors(docs: DataFrame) -> DataFrame:
    """Documents block by block: rows with lang and source hold numbers of chunks, rows with a chunk say what a number is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                yield from block.add(*(x.as_py() for x in row))
                if block.pairs >= BLOCK_CHUNKS:
                    yield from block.rest()
                    block = Block(block.number + 1)
        yield from block.rest()
        del block
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(read, FACTORS)


def count_block(rows: pa.Table, names: pa.Table) -> pa.Table:
    """(lang, source, term, documents, occurrences) of a block, from its documents and the terms of its chunks."""
    lists = pc.split_pattern(names["terms"].combine_chunks(), " ")
    terms = lists.flatten().dictionary_encode()
    words, codes = terms.dictionary, terms.indices.to_numpy()
    number = names["number"].to_numpy()
    sizes = np.zeros(int(number.max(initial=-1)) + 2, np.int64)
    sizes[number + 1] = lists.value_lengths().to_numpy()
    # The terms of chunk number i are codes[starts[i]:starts[i + 1]]; chunks without any have no row.
    codes, starts = codes[np.argsort(np.repeat(number, sizes[number + 1]), kind="stable")], sizes.cumsum()
    out = []
    del lists, terms, number
    by_group: dict[tuple[str, str], list[int]] = {}
    for i, key in enumerate(zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)):
        by_group.setdefault(key, []).append(i)
    for (lang, source), own in by_group.items():
        # Numbers are read for one group at a time; the others stay compressed.
        parts = [documents_of(*(rows[c][i].as_py() for c in ("sizes", "chunks", "counts"))) for i in own]
        documents, chunks, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        owner = np.repeat(np.arange(len(documents)), documents)
        known = chunks < len(starts) - 1
        owner, chunks, counts = owner[known], chunks[known], counts[known]
        size = starts[chunks + 1] - starts[chunks]
        at = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + np.repeat(starts[chunks], size)
        found, owner = codes[at].astype(np.int64), np.repeat(owner, size)
        occurrences = np.zeros(len(words), np.int64)
        np.add.at(occurrences, found, np.repeat(counts, size))
        once = np.bincount(np.unique(owner * len(words) + found) % max(1, len(words)), minlength=len(words))
        here = np.flatnonzero(once)
        out.append(pa.table({"lang": pa.repeat(pa.scalar(lang), len(here)), "source": pa.repeat(pa.scalar(source), len(here)),
                             "term": words.take(pa.array(here)), "documents": pa.array(once[here]), "occurrences": pa.array(occurrences[here])}))
    return pa.concat_tables(out)


def packed(counts: pa.Table, buckets: int) -> pa.Table:
    """(bucket, part): the rows of each bucket of terms, by term, as a compressed Arrow stream."""
    words = counts["term"].combine_chunks().dictionary_encode()
    of_word = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
    bucket = of_word[words.indices.to_numpy()]
    order = np.lexsort((pc.rank(words.dictionary).to_numpy()[words.indices.to_numpy()], bucket))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    found, parts = [], []
    for i in np.flatnonzero(np.diff(ends)):
        some = counts.take(pa.array(order[ends[i]:ends[i + 1]])).combine_chunks()
        for c in ("lang", "source", "term"):
            some = some.set_column(some.schema.get_field_index(c), c, some[c].dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(some)
        found.append(int(i))
        parts.append(sink.getvalue().to_pybytes())
    return pa.table({"bucket": pa.array(found, pa.int32()), "part": pa.array(parts, pa.binary())})


def summed(parts: Iterator[pa.Table]) -> pa.Table:
    """One row for each (lang, source, term): the sums over all parts, added up in turns so that few are held at once.

    What a turn leaves unused goes back to the system, else the allocator keeps several times what is held.
    """
    held: list[pa.Table] = []
    total = 0

    def add() -> pa.Table:
        # One thread: a task has one core, and every further thread would have a table of its own.
        every = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate(
            [("documents", "sum"), ("occurrences", "sum")])
        held.clear()
        pa.default_memory_pool().release_unused()
        return every.rename_columns({"documents_sum": "documents", "occurrences_sum": "occurrences"}).select(COUNTS)

    for part in parts:
        held.append(part)
        total += part.num_rows
        if len(held) > 1 and total > max(2 * held[0].num_rows, HELD):
            held.append(add())
            total = held[0].num_rows
    return add()


def term_counts(docs: DataFrame, blocks: int = 1024, chunks: int = 250_000) -> DataFrame:
    """(lang, source, term, documents, occurrences) of all texts.

    Each distinct chunk is taken apart once; its terms are joined to the blocks where it stands, and every block counts
    the documents and occurrences of its terms. A chunk's blocks meet its terms by chunk and part, a part being about
    ``blocks`` blocks, so a chunk that stands everywhere is spread as well. Counts leave their block packed, by buckets
    of terms, of which there is one for ``chunks`` distinct chunks; a bucket adds its parts up as they come.
    """
    rows = cut(factors(docs))
    stands = rows.where(F.col("chunk").isNotNull()).select("block", "chunk", "number")
    parts = -(-(rows.agg(F.count_distinct("block")).first()[0] or 1) // blocks)
    keys = ["chunk"]
    if parts > 1:
        keys, stands = ["chunk", "part"], stands.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    stands = stands.repartition(*keys)
    # The same columns as the other side of the join, so that both read one shuffle.
    known = stands.groupBy(*keys).agg(F.max("block").alias("block"), F.max("number").alias("number")).where("block >= 0 and number >= 0")
    if parts > 1:
        known = known.groupBy("chunk").agg(F.collect_set("part").alias("parts"))
    terms = F.array_join(F.regexp_extract_all(F.translate("chunk", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0)), " ")
    known = known.select("chunk", terms.alias("terms"), *(["parts"] if parts > 1 else [])).where("terms != ''")
    if parts > 1:
        known = known.select("chunk", "terms", F.explode("parts").alias("part"))
    names = stands.join(known, keys).select(F.col("block").alias("of"), "number", "terms")
    held = rows.where(F.col("chunk").isNull()).select("block", "lang", "source", "sizes", "chunks", "counts")
    buckets = 1 + (rows.agg(F.approx_count_distinct("chunk")).first()[0] or 0) // chunks

    def count(rows: pa.Table, names: pa.Table) -> pa.Table:
        if rows.num_rows and names.num_rows:
            found = packed(count_block(rows, names), buckets)
            pa.default_memory_pool().release_unused()  # workers stay, for the next block and for other tasks
            return found
        return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                for part in batch.column("part"):
                    table = pa.ipc.open_stream(part.as_buffer()).read_all()
                    yield table.cast(pa.schema([(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(COUNTS)]))

        yield from summed(tables()).to_batches(BATCH)
        pa.default_memory_pool().release_unused()

    counted = held.groupBy("block").cogroup(names.groupBy("of")).applyInArrow(count, "bucket int, part binary")
    return counted.groupBy("bucket").applyInArrow(add, "lang string, source string, term string, documents long, occurrences long")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)), exact at any size."""
    whole = "CAST({} AS DECIMAL(27, 0))".format
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + CAST({count} + 5 AS DECIMAL(20, 0)) * 1000000000BD div {whole(f'{total} + 5 * {terms}')} END")


def distances(vectors: DataFrame) -> DataFrame:
    """(lang, g, h, f): the sum over terms of the absolute difference between the shares of sources number g and h.

    ``vectors``: lang, base (the share of each source of lang where it lacks the term), at and p (the sources that
    have it and their shares), stripe (which g). Tasks add up; only sums by pair leave them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, stripe), f in sums.items():
                g, h = (x.ravel() for x in np.indices(f.shape))
                rows = pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), f.size), pa.array(g + stripe * STRIPE, pa.int32()),
                     pa.array(h, pa.int32()), pa.array(f.ravel())], ["lang", "g", "h", "f"])
                yield from (rows.slice(a, BATCH) for a in range(0, len(rows), BATCH))
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                base = np.array(row["base"], np.int64)
                base[row["at"]] = row["p"]
                key = (row["lang"], row["stripe"])
                own = base[key[1] * STRIPE:(key[1] + 1) * STRIPE]
                if key not in sums:
                    if sums and (len(sums) + 1) * len(own) * len(base) > CELLS:
                        yield from out()
                    sums[key] = np.zeros((len(own), len(base)), np.int64)
                sums[key] += np.abs(own[:, None] - base)
        yield from out()

    return vectors.select("lang", "stripe", "base", "at", "p").mapInArrow(read, "lang string, g int, h int, f long")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which terms.

    ``docs`` has text, lang and source; null is '' in each. Other columns, of any name, are not read. A language keeps
    the terms of at least ``least`` of its documents; part ``pair`` lists every other source by the sum of absolute
    differences of shares, part ``term`` the ``top`` terms by which a source exceeds its language. Every (lang, source)
    that occurs has its pairs, with value 0 where no term is kept; repeated rows are documents of their own; ties go by
    item in UTF-8 order. Empty and blank texts have no terms but their group stands. A text of any length is one
    document, its chunks counted once each. Empty tables give an empty result.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = cut(term_counts(docs))
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("lang_count"))
               .where(F.col("documents") >= least).drop("documents"))
    counts = cut(counts.drop("documents").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(langs, "lang", "left").join(
        totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"]).withColumn("at", number)
    groups = cut(groups.withColumn("none", F.lit(0)).withColumn("base", share("none", "total", "terms")).drop("none"))

    shares = counts.join(groups.drop("base"), ["lang", "source"]).withColumn("p", share("occurrences", "total", "terms")).withColumn(
        "q", share("lang_count", "lang_total", "terms"))
    excess = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))

    every = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "base"))), lambda x: x["base"]).alias("base"))
    vectors = shares.groupBy("lang", "term").agg(F.collect_list("at").alias("at"), F.collect_list("p").alias("p")).join(every, "lang")
    vectors = vectors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.ceil(F.size("base") / STRIPE).cast("int") - 1)))
    apart = distances(vectors).groupBy("lang", "g", "h").agg(F.sum("f").alias("f"))
    one = groups.select("lang", "source", F.col("at").alias("g"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("h"))
    pairs = one.join(other, "lang").where("g != h").join(apart, ["lang", "g", "h"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value"))

    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(falling)).union(
        excess.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top))
