"""Ranked lexical search by presence masks.

The documents that hold an item's terms are grouped by which of the terms they hold; a
group's score is bounded from its mask alone, so groups are scored from the highest bound
down and the rest is left out as soon as no bound reaches the k-th best score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8, letters, digits and everything beyond ASCII
PAIRS = 400_000  # terms of items held by a task at a time
POSTINGS = 2_000_000  # of one block of documents
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order; bytes.lower() lowers A-Z only."""
    return TERM.findall(text.lower())


class Items:
    """Some items with the numbers of their terms, small enough for one task."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        self.numbers: dict[bytes, int] = {}
        self.ids = [item for item, _ in rows]
        self.terms = [np.array([self.numbers.setdefault(t.encode(), len(self.numbers)) for t in terms], np.int32)
                      for _, terms in rows]

    def __len__(self) -> int:
        return len(self.numbers)


def item_groups(items: DataFrame, pairs: int) -> Iterator[Items]:
    """All items with terms, dealt by hash into groups of about ``pairs`` terms, one group at a time in the driver."""
    from pyspark.sql.types import ArrayType, StringType

    @F.udf(ArrayType(StringType()))
    def distinct(texts):
        return sorted({t.decode("utf-8", "replace") for x in texts for t in terms_of((x or "").encode())})

    found = items.groupBy(F.col("item_id").alias("item")).agg(F.collect_set("text").alias("texts"))
    found = cut(found.select("item", distinct("texts").alias("terms")).where(F.size("terms") > 0))
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, -(-total // pairs))
    for g in range(groups if total else 0):
        rows = found.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item").collect()
        if rows:
            yield Items([(r["item"], r["terms"]) for r in rows])


def held(docs: DataFrame, group: Items) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term: its terms with repeats, and which of the group's it holds."""
    numbers = group.numbers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, sizes, ids, tfs = [], [], [0], [], []
            for at, text in enumerate(batch.column("text")):
                if not (found := terms_of((text.as_py() or "").encode())):
                    continue
                own = [(k, c) for t, c in Counter(found).items() if (k := numbers.get(t)) is not None]
                doc.append(at)
                n.append(len(found))
                ids += [k for k, _ in own]
                tfs += [c for _, c in own]
                sizes.append(len(ids))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, n long, ids array<int>, tfs array<long>")


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The m of each document, exact where 50 * n * N does not fit 64 bits too."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
    return 50 + 50 * n * documents // terms


class Block:
    """The postings of some documents, by term: document, and weight times saturated occurrences."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, impact: np.ndarray, documents: int):
        order = np.argsort(ids, kind="stable")
        ids, self.owner, self.impact = ids[order], owner[order], impact[order]
        self.present, self.starts = np.unique(ids, return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(ids) else np.zeros(0, np.int64)
        self.documents = documents

    def lists(self, terms: np.ndarray) -> list[int]:
        """Where the terms' lists are, of those that the block has and that weigh anything."""
        if not len(self.present):
            return []
        at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
        return at[(self.present[at] == terms) & (self.most[at] > 0)].tolist()


def masks(block: Block, lists: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct masks of matched terms as rows of 64-bit words, the documents by mask, and the bounds of each mask's run."""
    words = np.zeros((block.documents, -(-len(lists) // 64)), np.uint64)
    for j, a in enumerate(lists):
        words[block.owner[block.starts[a]:block.ends[a]], j // 64] |= np.uint64(1 << j % 64)
    documents = np.flatnonzero(words.any(axis=1))
    words = words[documents]
    order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
    words, documents = words[order], documents[order]
    new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1))) if len(words) else np.zeros(0, np.int64)
    return words[new], documents, np.append(new, len(documents))


def scores(block: Block, lists: list[int], documents: np.ndarray) -> np.ndarray:
    """The score of each of the given documents, ascending."""
    total = np.zeros(len(documents), np.int64)
    for a in lists:
        owner = block.owner[block.starts[a]:block.ends[a]]
        at = np.minimum(np.searchsorted(owner, documents), len(owner) - 1)
        total += np.where(owner[at] == documents, block.impact[block.starts[a]:block.ends[a]][at], 0)
    return total


def merged(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> Best:
    """The k first by falling score, then doc_id, null last."""
    order = np.lexsort((doc, null, -score))[:k]
    return score[order], doc[order], null[order]


def search(block: Block, terms: np.ndarray, doc: np.ndarray, null: np.ndarray, best: Best | None, k: int) -> Best | None:
    """``best`` and the block's documents together: the k first.

    Groups of equal masks are scored by falling bound, as many at once as hold k documents, then twice as
    many. A group whose bound equals the k-th score is scored too: its documents may have smaller ids.
    """
    if not (lists := block.lists(terms)):
        return best
    words, documents, ends = masks(block, lists)
    bound = np.zeros(len(words), np.int64)
    for j, a in enumerate(lists):
        bound += np.where(words[:, j // 64] >> np.uint64(j % 64) & np.uint64(1), block.most[a], 0)
    falling = np.argsort(-bound, kind="stable")
    upto = np.cumsum(np.diff(ends)[falling])
    bound, done, want = bound[falling], 0, k
    floor = int(best[0][-1]) if best and len(best[0]) == k else 1
    while done < len(falling) and bound[done] >= floor:
        last = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + want)) + 1
        last = min(max(last, done + 1), int(np.searchsorted(-bound, -floor, "right")))
        some = np.sort(np.concatenate([documents[ends[g]:ends[g + 1]] for g in falling[done:last]]))
        score = scores(block, lists, some)
        some, score = some[score >= floor], score[score >= floor]
        if best is None:
            best = merged(score, doc[some], null[some], k)
        else:
            best = merged(*(np.concatenate(x) for x in zip(best, (score, doc[some], null[some]), strict=True)), k)
        floor = max(floor, int(best[0][-1])) if len(best[0]) == k else floor
        done, want = last, want * 2
    return best


def found_in(docs: DataFrame, group: Items, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task's documents the k first of every item of the group."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[Best | None] = [None] * len(group.terms)
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids, tfs = lists.values.to_numpy(), batch.column("tfs").values.to_numpy()
            null = np.asarray(batch.column("doc_id").is_null())
            doc = batch.column("doc_id").fill_null(0).to_numpy()
            m = lengths(batch.column("n").to_numpy(), documents, terms)
            first = 0
            while first < len(doc):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + POSTINGS, "right")) - 1)
                a, b = ends[first], ends[last]
                owner = np.repeat(np.arange(last - first), np.diff(ends[first:last + 1]))
                tf = tfs[a:b].astype(np.int64)
                impact = weights[ids[a:b]] * (1_000_000_000 * tf // (1000 * tf + 20 * m[first:last][owner]))
                block = Block(ids[a:b], owner, impact, last - first)
                best = [search(block, t, doc[first:last], null[first:last], x, k)
                        for t, x in zip(group.terms, best, strict=True)]
                first = last
        kept = [(i, x) for i, x in enumerate(best) if x is not None and len(x[0])]
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(x[0]), i) for i, x in kept]), pa.int32()),
                 pa.array(np.concatenate([x[1] for _, x in kept]), pa.int64(), mask=np.concatenate([x[2] for _, x in kept])),
                 pa.array(np.concatenate([x[0] for _, x in kept]), pa.int64())], ["at", "doc_id", "score"])

    return docs.mapInArrow(find, "at int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents, scores above 0 only.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns, of any name, are not read.
    Documents are read once for each group of items (``pairs`` terms together), their terms written with
    counts; a second pass keeps k documents an item and task. Rows of one item_id are one item with the terms
    of all of them; every row of ``docs`` is a document of its own, so repeated rows rank one by one. Ties go
    to the smaller doc_id, a null one last. Null, empty and blank texts have no term: such documents count
    nowhere, such items have no rows, as with empty tables. Very long texts are read whole; their terms count
    once with their number.
    """
    spark = docs.sparkSession
    parts = []
    for group in item_groups(items.select(F.col("item_id").cast("long"), "text"), pairs):
        known = cut(held(docs, group))
        documents, terms = known.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        weights = np.zeros(len(group), np.int64)  # one number a term of the group
        for at, df in known.select(F.explode("ids").alias("at")).groupBy("at").count().collect():
            weights[at] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        names = spark.createDataFrame(list(enumerate(group.ids)), "at int, item_id long")
        parts.append(cut(found_in(known, group, weights, documents, terms, k)).join(F.broadcast(names), "at"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    falling = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
