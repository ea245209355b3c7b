"""Whole texts to token ids through the library's ids of each different pre-token.

Byte-pair merges never cross the bounds of pre-tokens, so the ids of a text are those of its pre-tokens in
order. Bounds are found with array operations, and each different pre-token is given to the library once;
its ids are kept in a table inside the worker. Texts with characters whose class or normal form
these bounds do not cover are given to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from fleetplan.llm.texts import BYTE_VALUES, blocks, mix, word_hashes

#: Pre-tokens kept in a worker's table; a full table is emptied.
WORKER_TABLE = 1_000_000

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.array(
    [
        _SPACE if b == 32 or 9 <= b <= 13
        else _LETTER if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
        else _DIGIT if 48 <= b <= 57
        else _OTHER
        for b in range(256)
    ],
    np.uint8,
)
_ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_APOSTROPHE = 39


class Table:
    """A hash table from 64-bit pre-token hashes to ids, in flat arrays with open addressing."""

    def __init__(self, entries: int = WORKER_TABLE):
        self.entries = entries
        self.slots = 1 << max(4, (2 * entries - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.rank = np.zeros(self.slots, np.int32)
        self.n = 0
        self.start = np.zeros(self.entries, np.int64)
        self.count = np.zeros(self.entries, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        mask = np.uint64(self.slots - 1)
        at = (hashes & mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self.keys[at]
            hit = keys == hashes[left]
            found[left[hit]] = self.rank[at[hit]]
            go = ~hit & (keys != 0)
            left, at = left[go], (at[go] + 1) & (self.slots - 1)
        return found

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray | None = None) -> None:
        """Add different hashes that are not in the table; at most ``entries`` in all."""
        ranks = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.count[ranks] = counts
        if ids is not None:
            self.start[ranks] = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids])
        self.n += len(hashes)
        at = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            _, firsts = np.unique(at[free], return_index=True)
            put = free[firsts]
            self.keys[at[put]] = hashes[left[put]]
            self.rank[at[put]] = ranks[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (self.slots - 1)


class Encoder:
    """Token ids of whole columns of text. Subclasses say where pre-tokens begin and encode them."""

    #: whether ids are kept, or only their number
    with_ids = True

    def __init__(self, path: str, known: tuple[np.ndarray, np.ndarray] | None = None, table: int = WORKER_TABLE):
        self.load(path)
        self.table = Table(table)
        self.known = None
        if known is not None:
            self.known = Table(max(1, len(known[0])))
            self.known.add(*known)

    def load(self, path: str) -> None:
        raise NotImplementedError

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """(data, starts, ends, hashes, rows left to the library): the pre-tokens of all other rows."""
        raise NotImplementedError

    def encode_spans(self, parts: list[str]) -> list[list[int]]:
        """The ids of single pre-tokens."""
        raise NotImplementedError

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts."""
        raise NotImplementedError

    def span_text(self, data: np.ndarray, start: int, end: int) -> str:
        return data[start:end].tobytes().decode()

    def _learn(self, data, starts, ends, hashes, missed) -> None:
        _, firsts = np.unique(hashes[missed], return_index=True)
        for lo in range(0, len(firsts), 100_000):
            new = missed[firsts[lo : lo + 100_000]]
            if self.table.n + len(new) > self.table.entries:
                raise OverflowError
            ids = self.encode_spans([self.span_text(data, s, e) for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint16, int(counts.sum())) if self.with_ids else None
            self.table.add(hashes[new], counts, flat)

    def _ranks(self, data, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids of all spans, and their ranks in the worker's table (-1: a known one)."""
        counts = np.zeros(len(hashes), np.int32)
        ranks = np.full(len(hashes), -1, np.int32)
        asked = np.arange(len(hashes))
        if self.known is not None:
            got = self.known.find(hashes)
            hit = got >= 0
            counts[hit] = self.known.count[got[hit]]
            asked = np.flatnonzero(~hit)
        found = self.table.find(hashes[asked])
        missed = asked[found < 0]
        if len(missed):
            try:
                self._learn(data, starts, ends, hashes, missed)
            except OverflowError:  # full: begin again with what this block needs
                self.table.clear()
                need = len(np.unique(hashes[asked]))
                if need > self.table.entries:
                    self.table = Table(need)
                self._learn(data, starts, ends, hashes, asked)
            found = self.table.find(hashes[asked])
        ranks[asked] = found
        counts[asked] = self.table.count[found]
        return counts, ranks

    def encode(self, column: pa.Array):
        """For each block of rows: (first row, row after the last, counts of ids by row, all ids in order)."""
        for first, last, data, offsets in blocks(column):
            lowered, starts, ends, hashes, odd = self.spans(data, offsets)
            counts, ranks = self._ranks(lowered, starts, ends, hashes)
            sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            bounds = sums[np.searchsorted(starts, offsets)]
            by_row = np.diff(bounds)
            flat = None
            if self.with_ids:
                shift = np.repeat(self.table.start[ranks] - sums[:-1], counts)
                flat = self.table.ids[np.arange(sums[-1]) + shift]
            if len(odd):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd.tolist()]
                whole = self.encode_texts(texts)
                if self.with_ids:
                    cuts, at = [], 0
                    for i, ids in zip(odd.tolist(), whole):
                        cuts += [flat[at : bounds[i]], np.asarray(ids, np.uint16)]
                        at = bounds[i]
                    flat = np.concatenate([*cuts, flat[at:]])
                by_row[odd] = [len(x) for x in whole]
            yield first, last, by_row, flat


def _rows_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The different rows that hold these places."""
    return np.unique(np.searchsorted(offsets, places, "right") - 1)


def _before(data: np.ndarray, first: int) -> np.ndarray:
    out = np.empty_like(data)
    out[1:] = data[:-1]
    out[:1] = first
    return out


def _after(data: np.ndarray) -> np.ndarray:
    out = np.empty_like(data)
    out[:-1] = data[1:]
    out[-1:] = 0
    return out


def _unusual(data: np.ndarray) -> np.ndarray:
    """Places outside of ASCII text and the Latin letters U+00C0 to U+00FF, and of openings of special tokens."""
    before, after = _before(data, 0), _after(data)
    high = data >= 128
    lead = data == 0xC3
    bad = high & ~lead & (before != 0xC3)
    bad |= lead & ((after == 0x97) | (after == 0xB7))
    bad |= (data < 32) & ~((data >= 9) & (data <= 13))
    bad |= (data == 0x3C) & (after == 0x7C)
    return np.flatnonzero(bad)


def _contractions(data: np.ndarray, at: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """Letters of the contraction after each apostrophe ('s 't 'm 'd, 're 've 'll), or 0."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[at + 1], padded[at + 2]
    room = row_end - at - 1
    n = np.zeros(len(at), np.int64)
    n[np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room >= 1)] = 1
    pair = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
    n[pair & (room >= 2)] = 2
    return n


def _row_starts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[1:] > offsets[:-1]]


class _Library(Encoder):
    def load(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode_texts(self, texts):
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    encode_spans = encode_texts


class ByteLevelEncoder(_Library):
    """Byte-level BPE whose pre-tokens may open with one space: contractions, letters, digits, others, white space."""

    def spans(self, data, offsets):
        n = len(data)
        kind = _CLASS[data]
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        heads = _row_starts(offsets)
        start[heads] = True
        head = np.zeros(n, bool)
        head[heads] = True
        # the last white space before something else opens a token, and a space takes what follows with it
        space = kind == _SPACE
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~head[1:]
        after_space = np.zeros(n, bool)
        after_space[1:] = last[:-1] & (data[:-1] == 32)
        start |= last
        start &= ~after_space
        odd = _unusual(data)
        at = np.flatnonzero(data == _APOSTROPHE)
        if len(at):
            row_end = offsets[np.searchsorted(offsets, at, "right")]
            letters = _contractions(data, at, row_end)
            previous = np.where(head[at], _SPACE, kind[at - 1])
            odd = np.concatenate([odd, at[(letters > 0) & (previous == _SPACE)]])
            cut = (letters > 0) & ((previous == _LETTER) | (previous == _DIGIT))
            at, letters, row_end = at[cut], letters[cut], row_end[cut]
            start[at + 1] = False
            ends = at + 1 + letters
            start[ends[ends < row_end]] = True
        return self._finish(data, offsets, start, odd, None)

    def _finish(self, data, offsets, start, odd, keep):
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        chosen = np.ones(len(starts), bool) if keep is None else keep[starts]
        odd = _rows_of(odd, offsets)
        if len(odd):
            skip = np.zeros(len(offsets) - 1, bool)
            skip[odd] = True
            chosen &= ~skip[np.searchsorted(offsets, starts, "right") - 1]
        starts, ends = starts[chosen], ends[chosen]
        return data, starts, ends, word_hashes(BYTE_VALUES[data], starts, ends), odd


class WordEncoder(ByteLevelEncoder):
    """Lower-cased BPE with word ends: contractions, letters, single digits, others; white space is dropped."""

    def spans(self, data, offsets):
        odd = _unusual(data)
        lowered = _ASCII_LOWER[data]
        lowered[(_before(data, 0) == 0xC3) & (data >= 0x80) & (data <= 0x9E)] += 0x20
        n = len(lowered)
        kind = _CLASS[lowered]
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        heads = _row_starts(offsets)
        start[heads] = True
        at = np.flatnonzero(lowered == _APOSTROPHE)
        if len(at):
            head = np.zeros(n, bool)
            head[heads] = True
            row_end = offsets[np.searchsorted(offsets, at, "right")]
            letters = _contractions(lowered, at, row_end)
            cut = (letters > 0) & (head[at] | (kind[at - 1] != _OTHER))
            at, letters, row_end = at[cut], letters[cut], row_end[cut]
            start[at + 1] = False
            ends = at + 1 + letters
            start[ends[ends < row_end]] = True
        return self._finish(lowered, offsets, start, odd, kind != _SPACE)


class PieceEncoder(Encoder):
    """SentencePiece BPE: pieces hold white space only at their beginning, and no line feed but alone.

    A text is cut before each run of spaces and before each line feed. The library puts a mark of its own
    before a text; a part from inside a text is encoded after a line feed, whose two ids are taken off.
    """

    with_ids = False

    def load(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) or len(self.model.encode("\n")) != 2

    def spans(self, data, offsets):
        n = len(data)
        space = data == 32
        start = data == 10
        start[1:] |= space[1:] & ~space[:-1]
        heads = _row_starts(offsets)
        start[heads] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        # U+2581 in a text reads as a space
        odd = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if not self.whole else heads
        odd = _rows_of(odd, offsets)
        if len(odd):
            skip = np.zeros(len(offsets) - 1, bool)
            skip[odd] = True
            chosen = ~skip[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[chosen], ends[chosen]
        hashes = word_hashes(BYTE_VALUES[data], starts, ends)
        head = np.zeros(n + 1, bool)
        head[heads] = True
        self._heads = head
        opening = head[starts]
        hashes[opening] = mix(hashes[opening])
        return data, starts, ends, hashes, odd

    def span_text(self, data, start, end):
        text = data[start:end].tobytes().decode()
        return (self._heads[start], text)

    def encode_spans(self, parts):
        found = self.model.encode([text if opens else "\n" + text for opens, text in parts], num_threads=1)
        return [ids if opens else ids[2:] for (opens, _), ids in zip(parts, found)]

    def encode_texts(self, texts):
        return self.model.encode(texts, num_threads=1)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str, known=None) -> Encoder:
    """The encoder of this worker; its table serves all of the worker's tasks. ``known``: a broadcast pair
    of arrays, hashes and numbers of ids."""
    name = (kind, path, known and known.value[2])
    if name not in _ENCODERS:
        _ENCODERS[name] = kind(path, known and known.value[:2])
    return _ENCODERS[name]
