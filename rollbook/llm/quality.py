"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention network
weighs the passages; the weighted mean of the encodings is scored. Only documents carry
labels, so the attention is learned from them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, utf8, word_codes, word_spans
from .rules import COMMON

PASSAGE = 64  # words
BUCKETS = 32  # of hashed words
FIT_DOCS, FIT_PASSAGES = 3000, 1000  # at most so many documents are learned from, none of them longer
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!", b".,;:?'\"()-", range(128, 256)]
_TABLE = np.zeros((len(_CLASSES), 256), np.int64)
for _i, _c in enumerate(_CLASSES):
    _TABLE[_i, list(_c)] = 1
FEATURES = len(_CLASSES) + 9 + BUCKETS


def _common_codes() -> np.ndarray:
    raw = [w.encode() for w in COMMON]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_codes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])), ends))


_COMMON = _common_codes()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the text of each; a text without words has one passage of zeros."""
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    codes = word_codes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(n + 1))
    inside = np.arange(len(owner)) - first[owner]
    opens = np.flatnonzero(inside % PASSAGE == 0)
    passage = np.cumsum(inside % PASSAGE == 0) - 1
    count = np.bincount(passage, minlength=len(opens)).astype(float)
    size = (ends - starts).astype(float)
    add = lambda x: np.add.reduceat(x.astype(float), opens) if len(opens) else np.zeros(0)
    columns = []
    letters = add(size)
    classes = []
    for table in _TABLE:
        total = np.concatenate(([0], np.cumsum(table[data])))
        classes.append(total[ends] - total[starts])
        columns.append(add(classes[-1]) / letters)
    accented = np.concatenate(([0], np.cumsum(np.concatenate(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E), [False])))))
    upper = classes[0] + accented[ends] - accented[starts] if len(data) else classes[0]
    same = np.concatenate(([False], (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))) if len(codes) else np.zeros(0, bool)
    order = np.lexsort((codes, passage))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    at = np.minimum(np.searchsorted(_COMMON, codes), len(_COMMON) - 1)
    rate = lambda x: add(x) / count
    columns += [
        rate(size) / 10, rate((size - rate(size)[passage]) ** 2) / 100, rate(upper == size), add(upper) / letters, rate(classes[3] > 0),
        rate(same), np.bincount(passage[order], fresh, len(opens)) / count,
        rate(_COMMON[at] == codes), np.log1p(count) / 5]
    hashed = np.bincount(passage * BUCKETS + (codes % np.uint64(BUCKETS)).astype(np.int64), minlength=len(opens) * BUCKETS).reshape(-1, BUCKETS)
    found = np.column_stack([*columns, hashed / count[:, None]]) if len(opens) else np.zeros((0, FEATURES))
    empty = np.flatnonzero(first[1:] == first[:-1])
    which = np.concatenate((owner[opens], empty))
    order = np.argsort(which, kind="stable")
    return np.concatenate((found, np.zeros((len(empty), FEATURES))))[order].astype(np.float32), which[order]


# ── the network ──────────────────────────────────────────────────────────────

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Encodings, attention and score of bags; ``first`` is the first passage of each."""
    x = (x - model["mean"]) / model["std"]
    sizes = np.diff(np.append(first, len(x)))
    pre = x @ model["W"] + model["b"]
    h = np.maximum(pre, 0)
    tanh, gate = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (tanh * gate) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    a = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"x": x, "sizes": sizes, "pre": pre, "h": h, "tanh": tanh, "gate": gate, "a": a, "z": z,
            "score": _sigmoid(z @ model["c"] + model["c0"])}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 300, width: int = 24, inner: int = 12,
        rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> dict:
    """Adam on the cross-entropy of the bags' labels."""
    rng = np.random.default_rng(seed)
    start = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    weights = {"W": start(x.shape[1], width), "b": np.zeros(width), "V": start(width, inner), "U": start(width, inner),
               "w": start(inner), "c": start(width), "c0": np.zeros(1)}
    fixed = {"mean": x.mean(0), "std": x.std(0) + 1e-3}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, steps + 1):
        f = forward(weights | fixed, x, first)
        g = (f["score"] - y) / len(y)
        dz = np.repeat(np.outer(g, weights["c"]), f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
        dg = np.outer(de, weights["w"])
        dt, du = dg * f["gate"] * (1 - f["tanh"] ** 2), dg * f["tanh"] * f["gate"] * (1 - f["gate"])
        dh = f["a"][:, None] * dz + dt @ weights["V"].T + du @ weights["U"].T
        dp = dh * (f["pre"] > 0)
        slopes = {"W": f["x"].T @ dp, "b": dp.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "w": (f["tanh"] * f["gate"]).T @ de,
                  "c": f["z"].T @ g, "c0": np.array([g.sum()])}
        for k, slope in slopes.items():
            slope = slope + decay * weights[k] * (k not in ("b", "c0"))
            m = moment[k][0] * 0.9 + slope * 0.1
            v = moment[k][1] * 0.999 + slope ** 2 * 0.001
            moment[k] = m, v
            weights[k] = weights[k] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return weights | fixed


# ── on Spark ─────────────────────────────────────────────────────────────────

def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_passages: int = FIT_PASSAGES) -> dict | float:
    """The model, or a constant score where the labels do not hold both classes.

    It is fitted on a bounded sample: the ``fit_docs`` labelled documents with the lowest
    hash of their id among those whose crc32 modulo 5 is not 0, as far as they have at
    most ``fit_passages`` passages. Ids with two different labels are left out.
    """
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 != 0").groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in runs(offsets):
                x, owner = passages(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                keep = [i for i in range(b - a) if cuts[i + 1] - cuts[i] <= fit_passages]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h").take(pa.array([a + i for i in keep], pa.int64())), batch.column("y").take(pa.array([a + i for i in keep], pa.int64())),
                     pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary())], names=["h", "y", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select(
        F.xxhash64("doc_id").alias("h"), F.col("y").cast("long"), "text")
    rows = sorted(map(tuple, joined.mapInArrow(encode, "h long, y long, x binary").collect()), key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.cumsum([0, *(len(b) for b in bags[:-1])])
    return fit(np.concatenate(bags).astype(float), first, y)


def score(docs: DataFrame, model: dict | float, threshold: float = 0.3) -> DataFrame:
    """``docs`` without its text, with score (0 to 1) and predicted (1 from ``threshold`` on).

    Every passage of every text is encoded; a null or empty text is one empty passage.
    Repeated rows get equal scores, an empty table gives none; columns named like the new
    ones are replaced, all others are kept.
    """
    kept = docs.drop("text", "score", "predicted")
    names, schema = kept.columns, kept.schema.add("score", "double").add("predicted", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in runs(offsets):
                if isinstance(model, float):
                    out.append(np.full(b - a, model))
                    continue
                x, owner = passages(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                out.append(forward(model, x.astype(float), np.searchsorted(owner, np.arange(b - a)))["score"])
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    return docs.drop("score", "predicted").mapInArrow(work, schema)
