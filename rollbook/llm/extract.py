"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks of text at block-level tags. Whether a block belongs to the main
text is decided for all blocks together: features of its ancestors and its text weigh for or
against, neighbours tend to agree, and Viterbi finds the best sequence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ── pages as blocks ──────────────────────────────────────────────────────────

# Element names of HTML.
BLOCK = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre
    search section select summary table tbody td textarea tfoot th thead tr ul""".split())
SILENT = frozenset("script style template title iframe svg math noembed noframes".split())  # their content is no text
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}  # a start tag ends these, if they are innermost
HELD = frozenset("ul ol menu dl table select".split())  # ... but not beyond these

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>
    |<[!?/][^>]*+>""", re.S | re.X)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?![^\s=/>])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""", re.I)
SIGN = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    name: str
    signs: frozenset[str]  # of itself and its ancestors
    number: int


@dataclass(slots=True)
class Piece:
    """A leaf block: where it stands, its text, and how many of its characters are links."""
    where: Element
    parent: int
    text: str
    linked: int


def signs_of(name: str, rest: str) -> list[str]:
    """What an element says of its content: its tag, and the words of its class, id and role."""
    found = [f"<{name}>"]
    if "=" in rest or "hidden" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role"):
                found += SIGN.findall(value.lower())
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                found.append("!hidden")
    return found


def pieces(page: str, known: frozenset[str] | dict | None = None) -> list[Piece]:
    """The leaf blocks of a page that have text, in page order.

    A block ends where a block-level element begins or ends; white space in it becomes one space. ``known`` are the
    signs of interest, all by default: with them no path of elements holds more signs than there are known ones.
    Each tag is read once, and end tags without an open element are passed over, so time follows the length of the page.
    """
    out: list[Piece] = []
    stack = [Element("", frozenset(), 0)]
    opened: dict[str, int] = {}
    unended: set[str] = set()
    words: list[str] = []
    numbers, linked, link = 1, 0, 0  # link: depth of the stack + 1 where a link is open
    at, last = 0, page.rfind(">") + 1

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(words).split()):
            out.append(Piece(stack[-1], stack[-2].number if len(stack) > 1 else 0, text, min(linked, len(text))))
        words.clear()
        linked = 0

    def pop() -> None:
        nonlocal link
        opened[stack.pop().name] -= 1
        if link > len(stack):
            link = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            words.append(text)
            if link:
                linked += len(text)

    while tag := TAG.search(page, at, last):
        say(page[at:tag.start()])
        at = tag.end()
        if not tag["name"]:
            continue
        name, rest = tag["name"].lower(), tag["rest"]
        if name == "br":
            words.append(" ")
        elif name == "a":
            link = 0 if tag["end"] else len(stack) + 1
        elif name in SILENT:
            if not tag["end"] and not rest.endswith("/") and name not in unended:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = last = len(page)
                else:
                    unended.add(name)
        elif name in BLOCK:
            flush()
            if tag["end"]:
                if opened.get(name):
                    while stack[-1].name != name:
                        pop()
                    pop()
                continue
            if opened.get("p") and stack[-1].name == "p" and name != "button":
                pop()
            if ended := ENDED_BY.get(name):
                depth = len(stack) - 1
                while depth and stack[depth].name not in HELD and stack[depth].name not in ended and len(stack) - depth < 4:
                    depth -= 1
                if stack[depth].name in ended:
                    while len(stack) > depth:
                        pop()
            if name != "hr":
                new = signs_of(name, rest)
                own = [s for s in new if known is None or s in known]
                signs = stack[-1].signs
                stack.append(Element(name, signs if signs.issuperset(own) else signs.union(own), numbers))
                opened[name] = opened.get(name, 0) + 1
                numbers += 1
    say(page[at:])
    flush()
    return out


# ── features ─────────────────────────────────────────────────────────────────

def step(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def features(found: list[Piece]) -> list[list[str]]:
    """What weighs on each block besides its ancestors' signs: its tag, its text, its place and its surroundings."""
    counts = [len(p.text.split()) for p in found]
    total = sum(counts) or 1
    around: dict[int, int] = {}
    for p, n in zip(found, counts, strict=True):
        around[p.parent] = around.get(p.parent, 0) + n
    out, before = [], 0
    for i, (p, n) in enumerate(zip(found, counts, strict=True)):
        size = len(p.text)
        link = p.linked / size
        sentence = p.text[-1] in ".!?…:;\"”»)" and n > 2
        length = step(n, 2, 4, 8, 15, 30, 60)
        group = step(around[p.parent] / total, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
        linked = step(link, 0.01, 0.25, 0.5, 0.9)
        own = [f"tag {p.where.name}", f"words {length}", f"link {linked}", f"link {linked} words {min(length, 4)}",
               f"sentence {sentence} words {min(length, 4)}", f"group {group}", f"group {group} link {linked}",
               f"commas {step((p.text.count(',') + p.text.count(';')) / n, 0.01, 0.05, 0.2)}",
               f"word length {step(size / n, 4, 6, 8, 12)}", f"before {step(before / total, 0.001, 0.1, 0.5, 0.9)}",
               f"after {step((total - before - n) / total, 0.001, 0.1, 0.5, 0.9)}",
               f"tag {p.where.name} group {group}", f"tag {p.where.name} link {linked}"]
        if "©" in p.text:
            own.append("copyright")
        if i == 0 or i == len(found) - 1:
            own.append("first" if i == 0 else "last")
        out.append(own)
        before += n
    return out


# ── the field ────────────────────────────────────────────────────────────────

@dataclass
class Field:
    """Weights for "main text" against "not": of a sign or feature, and of a label after another.

    ``steps[same]`` are the scores of (label before, label), one table for neighbours under one parent, one for others.
    """
    weights: dict[str, float]
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))


def emissions(found: list[Piece], weights: dict[str, float]) -> list[float]:
    """How much speaks for main text, a block each."""
    sums: dict[frozenset, float] = {}
    out = []
    for p, own in zip(found, features(found), strict=True):
        if (above := sums.get(p.where.signs)) is None:
            above = sums[p.where.signs] = sum(weights.get(s, 0.0) for s in sorted(p.where.signs))
        out.append(above + sum(weights.get(f, 0.0) for f in own))
    return out


def viterbi(scores: list[float], same: list[int], model: Field) -> list[int]:
    """The best labels of a chain; of equal ones those with "not" last."""
    if not scores:
        return []
    steps = model.steps.tolist()
    off, on = model.first[0], model.first[1] + scores[0]
    back: list[tuple[int, int]] = []
    for score, s in zip(scores[1:], same[1:], strict=True):
        t = steps[s]
        a, b, c, d = off + t[0][0], on + t[1][0], off + t[0][1], on + t[1][1]
        back.append((int(b > a), int(d > c)))
        off, on = max(a, b), max(c, d) + score
    labels = [int(on > off)]
    for before in reversed(back):
        labels.append(before[labels[-1]])
    return labels[::-1]


def neighbours(found: list[Piece]) -> list[int]:
    """Whether each block has the parent of the one before."""
    return [int(i > 0 and p.parent == found[i - 1].parent) for i, p in enumerate(found)]


def main_text(page: str, model: Field) -> str:
    found = pieces(page, model.weights)
    labels = viterbi(emissions(found, model.weights), neighbours(found), model)
    return "\n".join(p.text for p, keep in zip(found, labels, strict=True) if keep)


def likelihood(scores: np.ndarray, same: np.ndarray, there: np.ndarray, labels: np.ndarray, steps: np.ndarray, first: np.ndarray):
    """Log-likelihood of the labels of many chains, and its slopes by score, step and first label.

    Arrays are (place, chain); ``there`` marks places that a chain has. Forward and backward sums are kept as shares
    of the labels, so that chains of any length stay within range.
    """
    places, chains = scores.shape
    on = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    node = np.stack([1 - on, on], axis=2)
    move = np.exp(steps)[same]  # (place, chain, before, label)
    ahead, behind, scale = np.ones((places, chains, 2)), np.ones((places, chains, 2)), np.ones((places, chains))
    for t in range(places):
        now = np.exp(first) * node[0] if t == 0 else (ahead[t - 1, :, :, None] * move[t]).sum(axis=1) * node[t]
        total = now.sum(axis=1)
        scale[t] = np.where(there[t], total, 1)
        ahead[t] = np.where(there[t][:, None], now / total[:, None], ahead[t - 1])
    for t in range(places - 2, -1, -1):
        now = (move[t + 1] * (node[t + 1] * behind[t + 1])[:, None]).sum(axis=2) / scale[t + 1][:, None]
        behind[t] = np.where(there[t + 1][:, None], now, 1)
    chance = ahead * behind * there[:, :, None]
    pair = ahead[:-1, :, :, None] * move[1:] * (node * behind / scale[:, :, None])[1:, :, None] * there[1:, :, None, None]

    by_step, by_first = np.zeros_like(steps), -chance[0].sum(axis=0)
    for s in (0, 1):
        by_step[s] = -(pair * (same[1:, :, None, None] == s)).sum(axis=(0, 1))
    np.add.at(by_first, labels[0], 1)
    follow = there[1:]
    taken = same[1:][follow], labels[:-1][follow], labels[1:][follow]
    np.add.at(by_step, taken, 1)
    told = first[labels[0]].sum() + (scores * labels * there).sum() + steps[taken].sum()
    whole = np.log(scale).sum() + (np.logaddexp(0, scores) * there).sum()
    return told - whole, (labels - chance[:, :, 1]) * there, by_step, by_first


def aligned(found: list[str], told: list[str]) -> list[int]:
    """Which blocks make up the labelled text: a longest common subsequence, the latest blocks of equal ones."""
    best = np.zeros((len(found) + 1, len(told) + 1), np.int32)
    for i, x in enumerate(found):
        hit = np.fromiter((best[i, j] + (x == y) for j, y in enumerate(told)), np.int32, len(told))
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, best[i, 1:]))
    labels, i, j = [0] * len(found), len(found), len(told)
    while i and j:
        if found[i - 1] == told[j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            labels[i - 1] = 1
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return labels


def fit(pages: list[tuple[str, str]], rounds: int = 150, decay: float = 0.3, rate: float = 0.15) -> Field:
    """The field that makes the labels of (html, text) pages likeliest, less ``decay`` times half its squared weights (Adam)."""
    numbers: dict[str, int] = {}
    chains, labels = [], []
    for page, text in pages:
        if found := pieces(page):
            rows = [[numbers.setdefault(f, len(numbers)) for f in (*sorted(p.where.signs), *own)]
                    for p, own in zip(found, features(found), strict=True)]
            chains.append((rows, neighbours(found)))
            labels.append(aligned([p.text for p in found], text.split("\n")))
    if not chains:
        return Field({})
    groups, rows = [], []  # chains of about the same length
    order = np.array_split(sorted(range(len(chains)), key=lambda i: len(labels[i])), min(8, len(chains)))
    for group in order:
        shape = (len(labels[group[-1]]), len(group))
        there, same, gold = np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for at, i in enumerate(group):
            n = len(labels[i])
            there[:n, at], same[:n, at], gold[:n, at] = True, chains[i][1], labels[i]
        own = [chains[group[at]][0][place] for place, at in np.argwhere(there)]
        groups.append((slice(len(rows), len(rows) + len(own)), there, same, gold))
        rows += own
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sizes = np.array([len(numbers), 8, 2])
    cut = sizes.cumsum()[:2]
    x, low, high = np.zeros(sizes.sum()), np.zeros(sizes.sum()), np.zeros(sizes.sum())
    for turn in range(1, rounds + 1):
        w, steps, first = np.split(x, cut)
        score, by_score = np.bincount(owner, w[flat], len(rows)), np.zeros(len(rows))
        moves, firsts = np.zeros((2, 2, 2)), np.zeros(2)
        for own, there, same, gold in groups:
            scores = np.zeros(there.shape)
            scores[there] = score[own]
            _, here, by_step, by_first = likelihood(scores, same, there, gold, steps.reshape(2, 2, 2), first)
            by_score[own] = here[there]
            moves += by_step
            firsts += by_first
        slope = np.concatenate([np.bincount(flat, by_score[owner], len(numbers)), moves.ravel(), firsts]) - decay * x
        low, high = 0.9 * low + 0.1 * slope, 0.99 * high + 0.01 * slope**2
        x += rate / (1 + 3 * turn / rounds) * (low / (1 - 0.9**turn)) / (np.sqrt(high / (1 - 0.99**turn)) + 1e-8)
    w, steps, first = np.split(x, cut)
    return Field({f: float(w[i]) for f, i in numbers.items()}, steps.reshape(2, 2, 2), first)


# ── on Spark ─────────────────────────────────────────────────────────────────

def labelled_pages(spark: SparkSession, pages: int = 1000, seed: int = 11) -> DataFrame:
    """(html, text) of invented pages of many layouts with the main text of each, the same for the same seed."""
    from .layouts import page

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page(seed * 1_000_003 + i) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h for h, _ in made], pa.string()),
                                              pa.array([t for _, t in made], pa.string())], ["id", "html", "text"])

    return spark.range(pages).mapInArrow(make, "id long, html string, text string").select("html", "text")


def train(labelled: DataFrame, pages: int = 1000) -> Field:
    """A field fitted on at most ``pages`` labelled pages (html, text), chosen by hash of the html.

    Null html or text is empty; a page without blocks teaches nothing, and without pages every block is left out.
    Repeated rows weigh as often. A block is labelled by whether it is a line of the text, in order. Extra columns
    are not read.
    """
    rows = labelled.select(F.coalesce("html", F.lit("")).alias("html"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.orderBy(F.xxhash64("html"), "html", "text").limit(pages).collect()
    return fit([(r["html"], r["text"]) for r in rows])


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """``pages`` with a column text: the main text from the whole html, blocks in page order joined by line breaks.

    The result has every other column as it was but html, which is dropped, and a column text of its own, which is
    replaced. Null, empty or blank html, and pages of no main text, give ''. Rows are treated one by one, so repeated
    rows repeat; empty tables stay empty. A very long page takes time in proportion to its length.
    """
    names = [c for c in pages.columns if c not in ("html", "text")]
    kept = pages.select(F.struct(*names).alias("row") if names else F.lit(None).cast("int").alias("row"), "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) if x.is_valid else "" for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    schema = T.StructType([kept.schema["row"], T.StructField("text", T.StringType())])
    return kept.mapInArrow(read, schema).select(*(F.col("row").getField(c).alias(c) for c in names), "text")
