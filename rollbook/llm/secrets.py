"""Secret scans: all rules in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import runs, utf8

@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, a shorter one inside every match to keep, and how long those are.

    No pattern may match a line break. ``core`` goes into the automaton; counters of several
    rules multiply its states, so a core counts no further than it must to be rare.
    """

    kind: str
    pattern: str
    core: str
    least: int = 0  # characters of the last group, or of the match where there is none
    tail: str = ""  # what follows a match and belongs to it; it may match line breaks


NAMES = "(?i:password|passwd|secret|token|api_?key)"
BASE = (
    Rule("assign", rf"""{NAMES}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         rf"""{NAMES}["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{12}}""", 12),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", 18),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16}", 16),
)
# A key goes to its END line; where there is none before the next BEGIN, to the end of the base64 lines that follow.
KEY_BODY = (r"(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]*PRIVATE KEY-----"
            r"|(?:[\x20\t]*[A-Za-z0-9+/]{16,}={0,2})?(?:[\x20\t\r]*\n[\x20\t]*(?:Proc-Type|DEK-Info):[^\n]*)*"
            r"(?:(?:(?:[\x20\t\r]*\n){1,2}[\x20\t]*[A-Za-z0-9+/]{32,}={0,2}(?=[\x20\t\r]*(?:\n|\Z)))+"
            r"(?:[\x20\t\r]*\n[\x20\t]*[A-Za-z0-9+/]{2,}={0,2}(?=[\x20\t\r]*(?:\n|\Z)))?)?")
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}", "xox[abprs]-"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}", "AIza"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN ", tail=KEY_BODY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?", "eyJ"),
)


# ── from patterns to transition arrays ───────────────────────────────────────

class Nfa:
    """Thompson automaton over bytes: for each state its byte edges and its empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, fold: bool = False) -> int:
        """Adds a parsed pattern from ``start`` on and returns its last state."""
        for op, arg in tree:
            if op in (C.LITERAL, C.IN):
                end = self.state()
                items = [(op, arg)] if op is C.LITERAL else arg
                letters = {b for kind, x in items for b in ([x] if kind is C.LITERAL else range(x[0], x[1] + 1))}
                if fold:
                    letters |= {ord(chr(b).swapcase()) for b in letters if chr(b).isalpha()}
                self.edges[start].append((frozenset(letters), end))
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.add(branch, first, fold)].append(end)
            elif op is C.SUBPATTERN:
                end = self.add(arg[3], start, fold or bool(arg[1] & re.IGNORECASE))
            elif op is C.MAX_REPEAT:
                low, high, what = arg
                end = start
                for _ in range(low):
                    end = self.add(what, end, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[end].append(loop)
                    self.empty[self.add(what, loop, fold)].append(loop)
                    end = loop
                else:
                    last = self.state()
                    for _ in range(high - low):
                        self.empty[end].append(last)
                        end = self.add(what, end, fold)
                    self.empty[end].append(last)
                    end = last
            else:
                raise ValueError(f"not in the pattern language: {op}")
            start = end
        return start

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    letter: np.ndarray  # class of each byte
    step: np.ndarray  # next state of (state, class)
    hits: np.ndarray  # bit i: rule i matches up to here
    resets: np.ndarray  # bytes after which every state is the first one


def compile_rules(cores: tuple[str, ...]) -> Automaton:
    """Subset construction over byte classes from a start that is never left, then minimisation."""
    nfa = Nfa()
    first = nfa.state()
    ends = {}
    for i, core in enumerate(cores):
        begin = nfa.state()
        nfa.empty[first].append(begin)
        ends[nfa.add(parser.parse(core), begin)] = 1 << i
    sets = sorted({letters for edges in nfa.edges for letters, _ in edges}, key=sorted)
    of_byte = [tuple(b in s for s in sets) for b in range(256)]
    kinds = sorted(set(of_byte))
    letter = np.array([kinds.index(x) for x in of_byte])
    start = nfa.closed([first])
    number, rows, todo = {start: 0}, [], [start]
    by_set = {s: i for i, s in enumerate(sets)}
    for now in todo:
        row = []
        for kind in kinds:
            to = nfa.closed({t for s in now for letters, t in nfa.edges[s] if kind[by_set[letters]]} | {first})
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    step = np.array(rows)
    hits = np.array([sum(bit for end, bit in ends.items() if end in s) for s in todo])
    # Moore: states stay together while their hits and their successors' blocks agree.
    block = np.unique(hits, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    order = np.unique(block, return_index=True)[1]
    step, hits, zero = block[step[order]], hits[order], block[0]
    swap = np.arange(len(order))
    swap[[0, zero]] = swap[[zero, 0]]
    step, hits = swap[step][swap], hits[swap]
    resets = np.flatnonzero((step == 0).all(0)[letter])
    return Automaton(letter.astype(np.uint8), step.astype(np.int32), hits.astype(np.int32), resets)


@cache
def automaton(cores: tuple[str, ...]) -> Automaton:
    return compile_rules(cores)


def scan_bytes(machine: Automaton, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which some rule matches, and the rules as bits: every byte is read once.

    The bytes are cut into lanes right after reset bytes, where the state is known; all
    lanes step together.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    is_reset = np.zeros(256, bool)
    is_reset[machine.resets] = True
    free = np.flatnonzero(is_reset[data]) + 1
    nominal = np.arange(1, lanes) * (len(data) // lanes + 1)
    at = np.searchsorted(free, nominal[nominal < len(data)])
    cuts = np.unique(np.concatenate(([0], free[at[at < len(free)]], [len(data)])))
    begin, size = cuts[:-1], np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    letters, classes = machine.letter[data], machine.step.shape[1]
    step, hits = machine.step.ravel(), machine.hits
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # lanes longer than t
    state = np.zeros(len(begin), np.int32)
    where, what = [], []
    for t in range(size[0]):
        n = active[t]
        state = step[state[:n] * classes + letters[begin[:n] + t]]
        found = hits[state]
        if found.any():
            i = np.flatnonzero(found)
            where.append(begin[i] + t)
            what.append(found[i])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(where), np.concatenate(what)


def find(column: pa.Array, rules: tuple[Rule, ...], machine: Automaton) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in code points, sorted.

    The automaton says which rules match in which lines; there the rule's own pattern
    sets the ends, leftmost first and without overlap within a rule. A tail goes on from
    there, over line breaks, in the same text.
    """
    # ASCII: letters of other alphabets that fold to k or s are none of a name's letters, as for the automaton.
    patterns, tails = [re.compile(r.pattern, re.ASCII) for r in rules], [r.tail and re.compile(r.tail, re.ASCII) for r in rules]
    data, offsets = utf8(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for a, b in runs(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        where, what = scan_bytes(machine, part)
        if not len(where):
            continue
        owner = np.searchsorted(at, where, "right") - 1
        breaks = np.flatnonzero(part == 10)
        i = np.searchsorted(breaks, where)
        low = np.maximum(np.concatenate(([-1], breaks))[i] + 1, at[owner])
        high = np.minimum(np.concatenate((breaks, [len(part)]))[i], at[owner + 1])
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        lines, inverse = np.unique(low, return_inverse=True)
        bits = np.zeros(len(lines), np.int64)
        np.bitwise_or.at(bits, inverse, what)
        pick = np.unique(inverse, return_index=True)[1]
        read, whole = -1, ""
        for bit, x, y, doc in zip(bits, low[pick], high[pick], owner[pick], strict=True):
            line, shift = part[x:y].tobytes().decode(), int(points[x] - points[at[doc]])
            for r, rule in enumerate(rules):
                if not bit >> r & 1:
                    continue
                spans = [(shift + m.start(), r, shift + m.end()) for m in patterns[r].finditer(line) if len(m[m.re.groups]) >= rule.least]
                if rule.tail and spans:
                    if doc != read:
                        read, whole = doc, part[at[doc]:at[doc + 1]].tobytes().decode()
                    spans = [(s, r, m.end() if (m := tails[r].match(whole, e)) else e) for s, r, e in spans]
                out[a + doc] += spans
    return [sorted(x) for x in out]


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` without its text, with ``found``: the spans of all rules, by start, then rule.

    Offsets are code points, ends exclusive. Spans of one rule never overlap; those of
    two rules may. Null and empty texts have none; a column named found is replaced.
    Texts are read whole, in memory proportional to one Arrow batch.
    """
    kept = docs.drop("text", "found")
    names, schema = kept.columns, kept.schema.add("found", _SPANS)
    kinds, machine = [r.kind for r in rules], automaton(tuple(r.core for r in rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in x] for x in find(batch.column("text"), rules, machine)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spans, _ARROW)], names=[*names, "found"])

    return docs.drop("found").mapInArrow(work, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``, overlapping spans by one; n_chars follows where it is a column.

    Texts without a secret, null ones too, come back as they are.
    """
    names, machine = docs.columns, automaton(tuple(r.core for r in rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), find(batch.column("text"), rules, machine)
            hit = [i for i, x in enumerate(spans) if x]
            if hit:
                new = dict(zip(hit, (_replaced(texts[i].as_py(), spans[i], mark) for i in hit), strict=True))
                kind = texts.type
                at = np.zeros(len(texts), bool)
                at[hit] = True
                texts = pc.replace_with_mask(texts, pa.array(at), pa.array(new.values(), kind))
                columns = {"text": texts}
                if "n_chars" in names:
                    chars = batch.column("n_chars").to_pylist()
                    for i, t in new.items():
                        chars[i] = len(t)
                    columns["n_chars"] = pa.array(chars, batch.column("n_chars").type)
                batch = pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in names], names=names)
            yield batch

    return docs.mapInArrow(work, docs.schema)


def _replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at, covered = [], 0, -1
    for start, _, end in spans:
        if start >= covered:
            out += [text[at:start], mark]
        covered = at = max(at, end)
    return "".join(out) + text[at:]
