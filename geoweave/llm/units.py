"""Encoding texts piece by piece, each distinct piece once.

The patterns of byte-level BPE never match across the place before a space that a visible character follows, nor across
that between a letter and a mark other than an apostrophe; a text is cut there and its ids are those of the pieces in a row. Arrow numbers the distinct pieces of some texts; a worker keeps the
ids of those that it has met, and puts the ids of a text together by array operations.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from geoweave.llm import text as tx

#: Bytes of pieces that a worker keeps, with what each takes besides; beyond them it starts afresh.
KEPT, EACH = 64 << 20, 180
#: Bytes of text that are cut at a time; a longer text is taken alone.
SLICE = 1 << 21

# A text may be cut before a space followed by one of these: visible ASCII, and first bytes of UTF-8 characters but for
# the four that white space can begin with (0xC2, 0xE1, 0xE2, 0xE3), where a text stays whole.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[0xE1:0xE4] = False
_SEEN = bytes(_VISIBLE)
# ASCII letters, and ASCII marks that no pattern joins to a letter before them.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def strings(parts: list[bytes]) -> list[str]:
    """Each as text, all at once."""
    out = b"\0".join(parts).decode().split("\0")
    return out if len(out) == len(parts) else [p.decode() for p in parts]


class Table:
    """Byte or number strings one after the other, gathered by their number."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.at = data, np.append(0, np.cumsum(sizes, dtype=np.int64))

    @classmethod
    def of_bytes(cls, parts: list[bytes]) -> Table:
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)), np.int64))

    @classmethod
    def of_lists(cls, parts: list[list[int]]) -> Table:
        sizes = np.array(list(map(len, parts)), np.int64)
        return cls(np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum())), sizes)

    def extend(self, more: Table) -> None:
        self.at = np.append(self.at, more.at[1:] + self.at[-1])
        self.data = np.concatenate((self.data, more.data))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of rows as one, and where each begins, with the end."""
        size = self.at[rows + 1] - self.at[rows]
        return self.data[tx.ranges(self.at[rows], size)], np.append(0, np.cumsum(size))


class Units:
    """Texts to ids. encode(free, others) gives a table of the ids of whole pieces; each of `free` begins with a space and a
    visible character, so they keep their ids when they stand side by side as one text."""

    def __init__(self, encode: Callable[[list[str], list[str]], Table], added: list[bytes] = (), whole: Callable[[str], list[int]] | None = None):
        """added: tokens that an encoder finds in a text before its patterns; a text that holds one is not cut but goes to `whole`."""
        self._encode, self._added, self._whole = encode, added, whole
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        self._size, self._table = 0, Table(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self._number.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(out < 0)
        new = [pieces[i] for i in at.tolist()]
        if self._size + sum(map(len, new)) + EACH * len(new) > KEPT and self._number:
            self._forget()
            at, new = np.arange(len(pieces)), pieces
        if new:
            free = np.array([p[0] == 0x20 and len(p) > 1 and _SEEN[p[1]] for p in new], bool)
            parts = [list(compress(new, which)) for which in (free.tolist(), (~free).tolist())]
            self._table.extend(self._encode(*map(strings, parts)))
            fresh = len(self._number)
            self._number.update(zip(chain(*parts), range(fresh, fresh + len(new))))
            out[np.concatenate((at[free], at[~free]))] = np.arange(fresh, fresh + len(new))
            self._size += sum(map(len, new)) + EACH * len(new)
        return out

    def _holding(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that hold an added token."""
        raw, found = data.tobytes() if self._added else b"", set()
        for token in self._added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]
                if inside:
                    found.add(row)
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        return sorted(found)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (their bytes, n + 1 offsets from 0) as one array, and n + 1 places where each text's begin."""
        holding = self._holding(data, offsets)
        if not holding:
            return self._of_pieces(data, offsets)
        out, sizes, row, rows = [], [], 0, len(offsets) - 1
        for held in [*holding, rows]:
            ids, first = self._of_pieces(data[offsets[row] : offsets[held]], offsets[row : held + 1] - offsets[row])
            out.append(ids)
            sizes.append(np.diff(first))
            if held < rows:
                ids = np.array(self._whole(data[offsets[held] : offsets[held + 1]].tobytes().decode()), np.uint32)
                out.append(ids)
                sizes.append(np.array([len(ids)]))
            row = held + 1
        return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes)))

    def _of_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(data), bool)
        first[1:-1] = (data[1:-1] == 0x20) & _VISIBLE[data[2:]]
        first[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        begins = offsets[:-1][np.diff(offsets) > 0]
        ends = begins[begins > 0] - 1
        first[ends[data[ends] == 0x20]] = False  # what follows the space belongs to another text
        first[begins] = True
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        ids, starts = self._table.gather(numbers)
        return ids, starts[np.searchsorted(at, offsets)]
