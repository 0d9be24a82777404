"""Token counts by a finite-state transducer compiled from the tokenizer.

In byte-pair encoding the tokens of a text's first i characters are those of its first p
characters and one more token t, for exactly one pair (p, t): t is a piece that ends at i,
and the last token before it and t stay apart when encoded alone. So a left-to-right
reader needs to know, for each place p from which the characters read so far may go on to
be a piece, only the last token before p and how many tokens more or less there were at
p than now. These are finitely many states. A transition is annotated with the number of
tokens that the text has more (or less) after it, and the annotations along a text add
up to its count.

Chunks of a text are read at once. A chunk's effect is a map from states to (state, sum);
maps compose, and a prefix scan over them gives each chunk its start. Chunks are cut where
a blank follows a non-blank, which brings every state to the same one, so the maps are
constant and the scan of the sums is all that is left of the composition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import runs, utf8

STATES_KEPT = 300_000  # a worker that has compiled more starts anew with the next batch
BLANK, LAST = 32, "▁".encode()[-1]  # the sign that blanks become may stand in a text itself


def _start(length: int, before: int, count: int) -> int:
    """A place a piece may begin at as one number: characters since, last token before (-1: any), tokens ahead."""
    return length << 32 | before + 1 << 8 | count + 128


FREE = _start(0, -1, 0)


class Transducer:
    """States and transitions over bytes, compiled as texts need them.

    A state is (the bytes of a character begun, the longest suffix read that may begin a
    piece, for each of its starts the last token before and the difference of counts).
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, n = self.model, self.model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.pieces = {model.id_to_piece(i): i for i in range(n) if not special(i)}
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("a piece goes on over a blank")
        self.begins = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        # What goes before a text, and where nothing can be joined with what went before.
        self.lead = [model.encode("\n")[:-1], model.encode("\n")]
        self.apart: dict[tuple[int, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.column = np.full(256, -1, np.int64)
        self.table = np.full((1024, 64), -1, np.int32)  # 256 * next state + count + 128
        self.root = self.state((b"", "", FREE))
        self.first, self.first_count = self._character(self.keys[self.root], "▁")
        if len(self.lead[0]) != self.first_count:
            raise ValueError("the tokenizer puts something else before a text")
        self.first = self.state(self.first)

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) > len(self.table):
                more = min(len(self.table), 1 << 15)
                self.table = np.concatenate((self.table, np.full((more, self.table.shape[1]), -1, np.int32)))
        return self.number[key]

    def _stays(self, before: int, piece: str) -> bool:
        """Whether the token ``before`` and ``piece`` are two tokens when encoded together."""
        key = before, piece
        if key not in self.apart:
            whole = self.model.encode("\n" + self.model.id_to_piece(before) + piece)
            self.apart[key] = whole == [*self.lead[1], before, self.pieces[piece]]
        return self.apart[key]

    def _character(self, key: tuple, char: str) -> tuple[tuple, int]:
        """The state after one more character, and how many tokens more there are."""
        _, suffix, *starts = key
        if char not in self.pieces:
            return (b"", "", FREE), len(char.encode())
        if char == "▁" and not suffix.endswith("▁"):  # no piece joins these: all that went before is settled
            suffix, starts = "", [FREE]
        grown = [(suffix[len(suffix) - (s >> 32):] + char, s) for s in starts]
        token, rise = next((piece, (s & 255) - 127) for piece, s in grown if piece in self.pieces and (
            s >> 8 & 0xFFFFFF == 0 or self._stays((s >> 8 & 0xFFFFFF) - 1, piece)))
        kept = [s + (1 << 32) - rise for begun, s in grown if begun in self.begins]
        longest = kept[0] >> 32 if kept else 0
        return (b"", (suffix + char)[len(suffix) + 1 - longest:], *kept, _start(0, self.pieces[token], 0)), rise

    def compile(self, state: int, byte: int) -> None:
        """Fills in one transition."""
        key = self.keys[state]
        begun = key[0] + bytes([byte])
        try:
            char = "▁" if begun == b" " else begun.decode()
        except UnicodeDecodeError:
            to, rise = (begun, *key[1:]), 0
        else:
            to, rise = self._character(key, char)
        number = self.state(to)
        self.table[state, self.column[byte]] = (number << 8) + rise + 128

    def letters(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte; bytes not met before get one."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        self.column[new] = self.column.max() + 1 + np.arange(len(new))
        while self.column.max() >= self.table.shape[1]:
            self.table = np.concatenate((self.table, np.full_like(self.table, -1)), axis=1)
        return self.column[data]

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The sum of each chunk's annotations; all chunks step together."""
        letter, width = self.letters(data), self.table.shape[1]
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], state[order]
        total = -128 * size
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        flat = self.table.ravel()
        for t, n in enumerate(active):
            at = state[:n] * width + letter[begin[:n] + t]
            found = flat.take(at)
            if found.min() < 0:
                for where in np.unique(at[found < 0]).tolist():
                    self.compile(where // width, int(np.flatnonzero(self.column == where % width)[0]))
                flat = self.table.ravel()
                found = flat.take(at)
            total[:n] += found & 255
            state = (found >> 8).astype(np.int64)
        out = np.empty_like(total)
        out[order] = total
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray, chunk: int) -> np.ndarray:
        """Tokens of each text."""
        if len(self.keys) > STATES_KEPT:
            self.clear()
        n = len(offsets) - 1
        starts = [offsets[:-1]]
        blanks = np.flatnonzero((data[1:] == BLANK) & (data[:-1] != BLANK) & (data[:-1] != LAST)) + 1
        for i in np.flatnonzero(np.diff(offsets) > chunk):
            wanted = np.arange(offsets[i] + chunk, offsets[i + 1], chunk)
            at = np.searchsorted(blanks, wanted)
            cut = blanks[at[at < len(blanks)]]
            starts.append(np.unique(cut[cut < offsets[i + 1]]))
        begin = np.concatenate(starts)
        state = np.full(len(begin), self.root)
        state[:n] = self.first
        owner = np.concatenate([np.arange(n), np.searchsorted(offsets, begin[n:], "right") - 1])
        order = np.lexsort((np.arange(len(begin)), begin, owner))
        begin, state, owner = begin[order], state[order], owner[order]
        end = np.append(begin[1:], offsets[-1])
        last = np.append(owner[1:] != owner[:-1], True)
        end[last] = offsets[owner[last] + 1]
        scan = np.cumsum(self.run(data, begin, end - begin, state))
        upto = scan[last]
        return np.diff(np.concatenate(([0], upto))) + np.where(np.diff(offsets) > 0, self.first_count, 0)


_transducers: dict[str, Transducer] = {}


def count(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 2048) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit.

    Tokens are those of the library for the model file, without begin and end. A null or
    empty text has 0 bytes and 0 tokens. Texts are read whole, in memory proportional to
    one Arrow batch; a stretch without blanks is one chunk, however long. Repeated rows
    get equal results, an empty table gives none; columns named like the new ones are
    replaced, all others are kept.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    docs = docs.drop(*new)
    kept = docs.drop("text")
    names, schema = kept.columns, kept.schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _transducers:
            _transducers[path] = Transducer(path)
        machine = _transducers[path]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            tokens = [machine.count(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], chunk) for a, b in runs(offsets, 8 << 20)]
            tokens = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=[*names, *new])

    return docs.mapInArrow(work, schema)
