"""Helpers shared by the corpus operators: words, byte views of texts, small joins, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"


# Names that operators give columns of their own, besides all that begin with an underscore.
INTERNAL = frozenset(("ref_classes", "ref_common", "copy"))


def set_aside(operator):
    """An operator on documents that is shown none of their columns named like its internal ones.

    They travel in one struct of a name that the documents lack and come back under their names, in place of the
    result's where it has such. Documents without such columns go to the operator as they are; a result that keeps no
    extra columns stays as it is.
    """
    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        names = [c for c in docs.columns if c.startswith("_") or c in INTERNAL]
        if not names:
            return operator(docs, *args, **how)
        aside = "own"
        while aside in docs.columns:
            aside += "_"
        col = lambda c: F.col("`" + c.replace("`", "``") + "`")
        shown = [c for c in docs.columns if c not in names]
        out = operator(docs.select(*map(col, shown), F.struct(*map(col, names)).alias(aside)), *args, **how)
        if aside not in out.columns:
            return out
        back = [F.col(aside).getField(c).alias(c) if c in names else col(c) for c in docs.columns if c in names or c in out.columns]
        return out.select(*back, *(col(c) for c in out.columns if c != aside and c not in docs.columns))

    return run


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters; null has none."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(bare, rf"{WORD}++[\x20\x09-\x0D]*+", ".")).cast("long")


def attach(df: DataFrame, small: DataFrame, key: str, rows: int = 20_000, salts: int = 64) -> DataFrame:
    """Left join of a table with one row per key, nulls matching nulls.

    ``small`` is counted first. Up to ``rows`` rows it is broadcast; beyond that it is
    copied ``salts`` times and joined on (key, salt), so a key that holds a third of
    ``df`` is still spread over many tasks.
    """
    small = small.withColumnRenamed(key, "_key")
    if small.count() <= rows:
        return df.join(F.broadcast(small), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    copies = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(salts)).cast("int"))
    return spread.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt2")), "left").drop(
        "_key", "_salt", "_salt2")


# ── texts as bytes ───────────────────────────────────────────────────────────

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array with n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts, and the text of each word."""
    solid = np.concatenate(([False], ~_BLANK[data], [False]))
    edge = solid[1:] != solid[:-1]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    joined = inner[solid[inner] & solid[inner + 1]]  # a word ends and another begins where two texts meet
    starts = np.sort(np.concatenate((np.flatnonzero(edge & solid[1:]), joined)))
    ends = np.sort(np.concatenate((np.flatnonzero(edge & solid[:-1]), joined)))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, back = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * power[:len(data)], dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(codes: np.ndarray, owner: np.ndarray, n: int, width: int = 5) -> list[np.ndarray]:
    """For each of ``n`` owners its sorted distinct hashed shingles of ``width`` words.

    An owner of fewer words has one shingle, the whole sequence; one without words, none.
    """
    bounds = np.searchsorted(owner, np.arange(n + 1))
    if len(codes) >= width:
        whole = sum((codes[j:len(codes) - width + 1 + j] * _PLACE[j] for j in range(width)), np.uint64(0))
        whole = mixed(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            part = (codes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(part + _PLACE[7:] * np.uint64(b - a)))
        else:
            out.append(codes[:0])
    return out


# ── connected components ─────────────────────────────────────────────────────

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges.

    Large-star and small-star by turns until every edge points at a root. Each turn is
    two aggregates and two equi-joins, written to the shared folder; nothing but a
    count and a checksum reaches the driver.
    """
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def running(partition: str, order: str, value: str) -> Column:
    """Sum of ``value`` over the rows before the current one."""
    return F.coalesce(F.sum(value).over(
        Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
