"""Quality rules: repetition, and distance of character and word histograms from the language's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACES, attach, set_aside

# Some of the most common words of four languages.
COMMON = list(dict.fromkeys((
    "the of and to in is that for "
    "der die und das den von ist mit "
    "de la le les et un une en "
    "que el los y del se por con").split()))

# Classes of characters: upper case, blank, symbol, digit or mark; all others are counted together after them.
CLASSES = [r"\p{Lu}", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[0-9.,;:?!'\"()-]"]
BLANK, SYMBOL = 1, 2


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _paired(half: Column, step: int) -> Column:
    """A hash of each item and the one ``step`` places on: windows of twice the length, side by side halves."""
    n = F.size(half) - step
    at = lambda first: F.slice(half, first, F.greatest(n, F.lit(0)))
    return F.when(n > 0, F.zip_with(at(1), at(step + 1), lambda x, y: F.xxhash64(x, y))).otherwise(
        F.array().cast("array<bigint>"))


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that come twice or more.

    Two equal windows of eight hold five pairs of equal windows of four, so most texts
    stop at a count of distinct windows of four.
    """
    spare = lambda x: F.size(x) - F.size(F.array_distinct(x))

    def covered(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda e, s, j: F.coalesce(e["h"] == F.get(s, j)["h"], F.lit(False))
        places = _let(order, lambda s: F.array_sort(F.filter(F.transform(
            s, lambda e, j: F.when(same(e, s, j - 1) | same(e, s, j + 1), e["i"])), lambda p: p.isNotNull())))
        steps = _let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(p, j + 1) - x, F.lit(8)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    two = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda one: _paired(one, 1))
    four = _let(two, lambda x: _paired(x, 2))
    return _let(four, lambda x: F.when(spare(x) < 5, none).otherwise(
        _let(_paired(x, 4), lambda eight: F.when(spare(eight) == 0, none).otherwise(covered(eight)))))


def _classes(text: Column) -> Column:
    """Counts of the character classes and of the rest."""
    counts = F.array(*((F.length(text) - F.length(F.regexp_replace(text, f"{c}++", ""))).cast("long") for c in CLASSES))
    rest = lambda c: (F.length(text) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
    return _let(counts, lambda c: F.concat(c, F.array(rest(c))))


def _common(words: Column) -> Column:
    """Counts of each common word and of all other words, in lower case and without end marks."""
    bare = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    short = max(len(w.encode()) for w in COMMON)
    kept = F.filter(bare, lambda w: (F.octet_length(w) <= short) & w.isin(COMMON))
    line = F.concat(F.lit(" "), F.array_join(kept, "  "), F.lit(" "))
    gone = lambda s, w: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(f" {w} "), F.lit("")))
    counts = lambda s: F.array(*((gone(s, w) / (len(w.encode()) + 2)).cast("long") for w in COMMON))
    return _let(line, lambda s: _let(counts(s), lambda c: F.concat(
        c, F.array(F.size(words) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))))


def _of_text(text: Column, body) -> Column:
    """``body`` of the text, null counting as empty, and its words."""
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(_words(t), lambda w: body(t, w)))


def histograms(text: Column) -> Column:
    """Struct of ``classes`` and ``common``: what is compared with the language."""
    return _of_text(text, lambda t, w: F.struct(_classes(t).alias("classes"), _common(w).alias("common")))


def measures(text: Column) -> Column:
    """Struct of the five base measures and the two histograms, each text being split into words once."""
    def of(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
        return _let(_classes(t), lambda c: F.struct(
            F.size(w).cast("long").alias("n_words"), (F.length(t) - c[BLANK]).alias("word_chars"), c[SYMBOL].alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"), c.alias("_classes"), _common(w).alias("_common")))

    return _of_text(text, of)


def references(histograms: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): each language's own histograms, summed over all its documents."""
    total = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    return histograms.groupBy("lang").agg(
        total("classes", len(CLASSES) + 1).alias("ref_classes"), total("common", len(COMMON) + 1).alias("ref_common"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 where either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    both = lambda n, m: F.aggregate(F.zip_with(counts, reference, lambda c, r: _let(c / n, lambda p: _let(
        r / m, lambda q: part(p, q) + part(q, p)))), F.lit(0.0), lambda a, x: a + x)
    found = _let(total(counts), lambda n: _let(total(reference), lambda m: F.when(
        (n > 0) & (m > 0), F.sqrt(F.greatest(both(n, m) / 2, F.lit(0.0)))).otherwise(0.0)))
    return F.coalesce(found, F.lit(0.0))


def verdict(class_distance: float, class_slack: float, class_words: int,
            word_distance: float, word_slack: float, word_words: int) -> list[tuple[str, Column]]:
    """base_failed and kept, from the measures and the two distances."""
    n = F.col("n_words")
    over = lambda found, limit, slack, least: (n >= least) & (F.col(found) > F.lit(limit) + F.lit(slack) / F.sqrt(n))
    far = over("class_distance", class_distance, class_slack, class_words) | over(
        "word_distance", word_distance, word_slack, word_words)
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return [("base_failed", failed), ("kept", ~failed & ~far)]


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
       "base_failed", "kept"]


@set_aside
def check(docs: DataFrame, class_distance: float = 0.2, class_slack: float = 0.6, class_words: int = 20,
          word_distance: float = 0.1, word_slack: float = 1.2, word_words: int = 60, keep_text: bool = False) -> DataFrame:
    """``docs`` with its measures, its two distances from its language and the verdict ``kept``.

    A text fails with under 20 words or with more than 30 % of them in windows of eight
    that come again. Else it is dropped if the histogram of its character classes or of
    its common words lies too far from the sum over all documents of its language. Chance
    alone puts a text of n words at a distance of about 1 / sqrt(n), so the limits are a
    constant plus a slack over sqrt(n), and texts shorter than the guards are not judged
    by a histogram.

    Null is a language of its own, like any other value. A null or empty text has no
    words and fails. Repeated rows get equal results, an empty table gives none; columns
    named like the new ones are replaced, all others but the text are kept.

    Without ``keep_text`` texts are read once and only numbers are written between the
    two steps. With it the text is read twice, and nothing of it is shuffled.
    """
    docs = docs.drop(*NEW, "_classes", "_common")
    rest = [c for c in docs.columns if c != "text" or keep_text]
    # The one-element generator keeps the measures one step: merged into what follows,
    # they would be worked out again wherever one of them is used.
    full = docs.select(*rest, F.inline(F.array(measures(F.col("text")))))
    if keep_text:
        refs = references(docs.select("lang", F.inline(F.array(histograms(F.col("text"))))))
    else:
        full = cut(full)
        refs = references(full.select("lang", F.col("_classes").alias("classes"), F.col("_common").alias("common")))
    full = attach(full, cut(refs), "lang").withColumns({
        "class_distance": distance(F.col("_classes"), F.col("ref_classes")),
        "word_distance": distance(F.col("_common"), F.col("ref_common"))})
    for name, value in verdict(class_distance, class_slack, class_words, word_distance, word_slack, word_words):
        full = full.withColumn(name, value)
    return full.drop("_classes", "_common", "ref_classes", "ref_common")
