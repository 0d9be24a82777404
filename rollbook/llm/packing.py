"""Packing token pieces into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import running, runs, utf8

WORDS_KEPT = 300_000  # tokenized words, and parts of words, that a worker remembers
# Words made of these parts need no normalizing but lower case; each part is a token run of its own.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!\"#$%&()*+,\-./:;=>?@\[\]^_`{|}~]+")
_PLAIN = re.compile(rf"(?:{_PARTS.pattern})+")


class Words:
    """A worker's tokenizer and its memory of words: bytes to the bytes of 32-bit ids.

    The tokenizer drops white space and no token crosses it, so a text's ids are those
    of its words one after the other. A plain word's parts go to the tokenizer's model
    directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in letters]
        self.spelling = dict(zip(others, range(256, 256 + len(others)), strict=True))

    def _part(self, part: str) -> bytes:
        part = part.lower()
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.spelling)
            found = self.parts[part] = array("I", [t.id for t in self.whole.model.tokenize(spelled)]).tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():
            return self._part(text)
        if word[:-1].isalpha() and word[-1:] in b".,":
            return self._part(text[:-1]) + self._part(text[-1])
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._part, _PARTS.findall(text)))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, words: list[bytes]) -> bytes:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        if len(self.parts) > WORDS_KEPT:
            self.parts.clear()
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


_tokenizers: dict[str, Words] = {}


def token_ids(texts: list[bytes], path: str, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text, then ``end_id``."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    end = array("I", [end_id]).tobytes()
    return [_tokenizers[path].ids(t.split()) + end for t in texts]


def pieces(docs: DataFrame, path: str, end_id: int = 1, room: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces of at most ``room`` tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in runs(offsets, 4 << 20):
                raw = data[offsets[a]:offsets[b]].tobytes()
                at = offsets[a:b + 1] - offsets[a]
                ids = token_ids([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], path, end_id)
                row, piece, parts = [], [], []
                for i, whole in enumerate(ids):
                    for p, start in enumerate(range(0, len(whole), 4 * room)):
                        row.append(a + i)
                        piece.append(p)
                        parts.append(whole[start:start + 4 * room])
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array([p * room for p in piece], pa.int64()), pa.array([len(x) // 4 for x in parts], pa.int64()),
                           pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


# ── the plan: from a histogram of lengths to patterns of sequences ───────────

def reduce_dominated(count: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Takes out of ``count`` what can be fixed for good: (sequences, [(length, how often)]).

    Longest first, a length is fixed alone if nothing fits beside it; with the longest
    partner that fits if the two fill the room, if no two partners fit, or if no three
    fit and the partner is as long as any two that do. Each of these dominates every
    other set that holds the length, so a best packing with it exists.
    """
    lengths = sorted(k for k, n in count.items() if n > 0)
    fixed = []

    def smallest(n: int, but: int) -> list[int]:
        out = []
        for x in lengths:
            out += [x] * min(n - len(out), count[x] - (x == but))
            if len(out) == n:
                break
        return out

    def best_pair(left: int) -> int:
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            x, y = lengths[i], lengths[j]
            if x + y > left or (i == j and count[x] < 2):
                j -= 1
            else:
                best, i = max(best, x + y), i + 1
        return best

    for a in sorted(lengths, reverse=True):
        while count.get(a, 0) > 0:
            least = smallest(3, a)
            left = room - a
            if not least or least[0] > left:
                fixed.append((count[a], [(a, 1)]))
                count[a] = 0
            else:
                at = bisect_left(lengths, left + 1) - 1
                if lengths[at] == a and count[a] < 2:
                    at -= 1
                k = lengths[at]
                if not (a + k == room or len(least) < 2 or sum(least[:2]) > left
                        or ((len(least) < 3 or sum(least) > left) and k >= best_pair(left))):
                    break
                n = count[a] // 2 if k == a else min(count[a], count[k])
                fixed.append((n, [(a, 2)] if k == a else [(a, 1), (k, 1)]))
                count[a] -= n
                count[k] -= n
            lengths = [x for x in lengths if count[x] > 0]
    return fixed


def best_fit(count: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on groups of equal sequences: (sequences, [(length, how often)])."""
    open_: dict[int, list[tuple[int, list]]] = {}
    spaces: list[int] = []

    def put(space: int, n: int, pattern: list) -> None:
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((n, pattern))

    for length in sorted((k for k, n in count.items() if n > 0), reverse=True):
        left = count[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, n, pattern = room, -(-left // (room // length)), []
            else:
                space = spaces[at]
                n, pattern = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            each = space // length
            full = min(n, left // each)
            if full:
                put(space - each * length, full, [*pattern, (length, each)])
                left -= full * each
                n -= full
            if n and 0 < left < each:
                put(space - left * length, 1, [*pattern, (length, left)])
                left, n = 0, n - 1
            if n and pattern:
                put(space, n, pattern)
    return [group for groups in open_.values() for group in groups]


def slots(count: dict[int, int], room: int) -> np.ndarray:
    """Rows (length, first rank, sequences, how often each, first sequence, offset), sorted.

    Pieces of one length are told apart by their rank only, so the plan's size depends
    on the number of lengths, at most ``room``, and not on the number of pieces.
    """
    left = dict(count)
    groups = reduce_dominated(left, room) + best_fit(left, room)
    rank: dict[int, int] = dict.fromkeys(count, 0)
    rows, sequence = [], 0
    for n, pattern in groups:
        offset = 0
        for length, each in pattern:
            rows.append((length, rank[length], n, each, sequence, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, end_id: int = 1, room: int = 4096, with_ids: bool = False, salts: int = 64) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, in few sequences of at most ``room`` tokens.

    Only documents longer than ``room`` are cut, and only their last piece may be
    shorter. Spark counts the pieces of each length (at most ``room`` numbers reach the
    driver); the plan is made from these counts: dominated choices are fixed, the rest
    is packed by best fit, always for all equal sequences at once. Pieces then take the
    places of their length in the order of a rank counted by (length, salt), so no
    length, however common, is in one task.

    A null or empty text is the end token alone. Repeated rows are packed as often as
    they come; a null id stays null. Columns other than doc_id and text are ignored; an
    empty table gives no rows. ``with_ids`` adds the ids as 32-bit little-endian bytes.
    """
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    found = cut(pieces(docs, path, end_id, room, with_ids).withColumn("_salt", salt))
    by = cut(found.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    count = {r[0]: r[1] for r in by.groupBy("length").agg(F.sum("_n")).collect()}
    plan = slots(count, room)
    skip = by.select("length", "_salt", running("length", "_salt", "_n").cast("long").alias("_skip"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = found.withColumn("_rank", within.cast("long")).join(skip, ["length", "_salt"]).select(
        *found.drop("_salt").columns, (F.col("_rank") + F.col("_skip")).alias("_rank"))
    key = (plan[:, 0] << 44) | plan[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = plan[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            inside = rank - at[:, 1]
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(at[:, 4] + inside // at[:, 3]),
                 pa.array(at[:, 5] + inside % at[:, 3] * length)], names=[*kept, "sequence_id", "offset"])

    schema = found.drop("_salt").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(put, schema)
