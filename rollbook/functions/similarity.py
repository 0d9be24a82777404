"""String, bit-string and vector similarities.

``token_sort_ratio`` is 100 * (1 - indel / (len a + len b)) on sorted tokens; the
indel distance comes from a bit-parallel longest common subsequence, run over whole
Arrow batches with 64-bit words (Python integers beyond 64 characters).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import ratios
from .text import words


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


# ── kernel ───────────────────────────────────────────────────────────────────

def _lcs_long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Texts:
    """Distinct texts as code arrays over one alphabet, ready for pairwise LCS."""

    def __init__(self, texts: list[str], alphabet: dict[str, int] | None = None):
        self.texts = texts
        self.alphabet = {} if alphabet is None else alphabet
        for t in texts:
            for ch in t:
                if ch not in self.alphabet:
                    self.alphabet[ch] = len(self.alphabet)
        self.length = np.fromiter((len(t) for t in texts), np.int64, len(texts))

    def masks(self, n_codes: int) -> np.ndarray:
        """One 64-bit position mask per (text, character); the last column is padding."""
        out = np.zeros((len(self.texts), n_codes + 1), np.uint64)
        for i, t in enumerate(self.texts):
            for j, ch in enumerate(t[:64]):
                out[i, self.alphabet[ch]] |= np.uint64(1 << j)
        return out

    def codes(self, n_codes: int) -> np.ndarray:
        width = int(self.length.max()) if len(self.texts) else 0
        out = np.full((len(self.texts), width), n_codes, np.int32)
        for i, t in enumerate(self.texts):
            out[i, : len(t)] = [self.alphabet[ch] for ch in t]
        return out


class PairScorer:
    """LCS lengths for index pairs into two text lists."""

    def __init__(self, left: list[str], right: list[str]):
        alphabet: dict[str, int] = {}
        self.a, self.b = Texts(left, alphabet), Texts(right, alphabet)
        n = len(alphabet)
        self.masks, self.codes = self.a.masks(n), self.b.codes(n)

    def lcs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        la = self.a.length[i]
        full = np.where(la >= 64, np.uint64(2**64 - 1),
                        (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
        v = full.copy()
        width = int(self.b.length[j].max()) if len(j) else 0
        for k in range(width):
            u = v & self.masks[i, self.codes[j, k]]
            v = (v + u) | (v - u)
        out = la - np.bitwise_count(v & full).astype(np.int64)
        for p in np.flatnonzero(la > 64):
            out[p] = _lcs_long(self.a.texts[i[p]], self.b.texts[j[p]])
        return out

    def ratio(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Indel similarity 0..100; two empty texts count as 0."""
        total = self.a.length[i] + self.b.length[j]
        dist = total - 2 * self.lcs(i, j)
        return np.where(total > 0, (1.0 - dist / np.maximum(total, 1)) * 100.0, 0.0)


@F.pandas_udf(T.DoubleType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        ia, ua = pd.factorize(a[known])
        ib, ub = pd.factorize(b[known])
        out[known] = PairScorer(list(ua), list(ub)).ratio(ia, ib)
    return pd.Series(out).where(pd.Series(known), None)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts whose tokens are already sorted."""
    return _indel_ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _indel_ratio(sort_tokens(a), sort_tokens(b))


def may_reach(a: Column, b: Column, threshold: int) -> Column:
    """Native filter that loses no pair with similarity >= ``threshold`` (0..100).

    Levenshtein distance never exceeds indel distance, so a pair over the indel
    budget in Levenshtein terms is over it for certain. Integer arithmetic only.
    """
    budget = F.call_function("div", F.lit(100 - threshold) * (F.length(a) + F.length(b)), F.lit(100))
    return F.call_function("levenshtein", a, b, budget.cast("int")) >= 0


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        pairs = pd.DataFrame({"a": a[known], "b": b[known]})
        at, distinct = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy(), pairs.drop_duplicates()
        out[known] = ratios(distinct["a"].tolist(), distinct["b"].tolist())[at]
    return pd.Series(out).where(pd.Series(known), None)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio 0..1 (see ``sequences``); argument order matters."""
    return _sequence_ratio(a, b)


# ── bits ─────────────────────────────────────────────────────────────────────

def hex_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-fA-F]{1,16}$"), F.lit(False))


def hex_halves(c: Column) -> tuple[Column, Column]:
    """A hex string of up to 16 digits as two 32-bit numbers (high, low)."""
    padded = F.lpad(c, 16, "0")
    half = lambda pos: F.conv(F.substring(padded, pos, 8), 16, 10).cast("bigint")
    return half(1), half(9)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings; 64 when either cannot be read."""
    (ah, al), (bh, bl) = hex_halves(a), hex_halves(b)
    bits = F.bit_count(ah.bitwiseXOR(bh)) + F.bit_count(al.bitwiseXOR(bl))
    return F.when(hex_ok(a) & hex_ok(b), bits).otherwise(F.lit(64)).cast("int")


def row_fingerprint(name: Column, address: Column, image_hash: Column) -> Column:
    return F.concat(F.upper(F.concat(name, F.lit("|"), address)), F.lit("#"), image_hash)


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """0.7 text + 0.3 image on 0..1; 0 when a fingerprint has no image part."""
    usable = F.contains(a, F.lit("#")) & F.contains(b, F.lit("#"))
    text = lambda c: F.substring_index(c, "#", 1)
    image = lambda c: F.substr(c, F.instr(c, "#") + 1)
    score = (token_sort_ratio(text(a), text(b)) / 100 * 0.70
             + (1.0 - hamming_hex(image(a), image(b)) / 36.0) * 0.30)
    return F.when(usable, score).otherwise(F.lit(0.0))


# ── vectors ──────────────────────────────────────────────────────────────────

def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def register(spark) -> None:
    """Make the Arrow functions callable from SQL text."""
    spark.udf.register("indel_ratio", _indel_ratio)
    spark.udf.register("sequence_ratio", _sequence_ratio)
    from .text import _fold_unicode
    spark.udf.register("fold_unicode", _fold_unicode)
