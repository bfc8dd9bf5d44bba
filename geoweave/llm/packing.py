"""Documents packed into sequences of bounded length: bounded-space online best-fit.

A task takes pieces as they come and keeps a fixed number of bins open. A piece goes to the fullest bin that has room for
it: bins stand in lists by their free space, and the bits of one integer tell which of these lists hold any, so that bin is
the lowest bit from the piece's length on. If all bins are too full a new one is opened, and where that is one too many the
fullest is closed. Bins that are full close at once. A closed bin is a sequence; its pieces are put out together.

Best-fit does better the larger the pieces that come first, so a task looks ahead over WINDOW pieces and takes them longest
first. What still stands in bins with room when the rows of a task end (at most OPEN bins) is dealt again and packed once
more, so that few sequences have room left however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.llm.tokenfiles import tokenizer
from geoweave.llm.units import SLICE
from geoweave.shared import written

#: Bins that a task keeps open, and pieces that it looks at before it places the longest; ids that are put out at a time.
OPEN, WINDOW, OUT = 1024, 1024, 1 << 20
#: A bin that is left with less room than this part of its size is done.
ROOM = 64
#: Ids for a task in the second pass.
AGAIN = 1 << 23

_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, left boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class Bins:
    """Open bins of `size`, at most `most`, each a list of (length, item); place() gives those that close."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.n = size, most, 0
        self._free, self._bits = [[] for _ in range(size + 1)], 0

    def _take(self, room: int) -> list:
        found = self._free[room].pop()
        if not self._free[room]:
            self._bits ^= 1 << room
        self.n -= 1
        return found

    def place(self, length: int, item) -> list[list]:
        """Puts a piece of 1 to `size` into the fullest bin with room for it."""
        fits, closed = self._bits >> length, []
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self._take(room)
        else:
            room, found = self.size, []
            if self.n >= self.most:  # the fullest closes first
                closed.append(self._take((self._bits & -self._bits).bit_length() - 1))
        found.append((length, item))
        room -= length
        if not room:
            return [*closed, found]
        self._free[room].append(found)
        self._bits |= 1 << room
        self.n += 1
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        """The bins that are still open, and their room."""
        for room, some in enumerate(self._free):
            for found in some:
                yield room, found


def _packed(pieces: Iterator[tuple], size: int, most: int, window: int, first_id: int, last: bool) -> Iterator[pa.RecordBatch]:
    """pieces (doc_id, piece, start, ids as bytes) in batches of _SCHEMA; unless it is the last pass, bins with room are `left`."""
    bins, n, rows, held = Bins(size, most), 0, [], 0

    def put(found: list, left: bool) -> None:
        nonlocal n, held
        at = 0
        for length, item in found:
            rows.append((*item[:3], length, item[3], first_id + n, at, left))
            at += length
        n, held = n + 1, held + at

    def batch() -> pa.RecordBatch:
        nonlocal rows, held
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        rows, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    def placed(some: list) -> Iterator[pa.RecordBatch]:
        for item in sorted(some, key=lambda x: -len(x[3])):
            for found in bins.place(len(item[3]) // 4, item):
                put(found, False)
            if held >= OUT:
                yield batch()

    ahead: list = []
    for piece in pieces:
        ahead.append(piece)
        if len(ahead) >= window:
            yield from placed(ahead)
            ahead = []
    yield from placed(ahead)
    for room, found in bins.rest():
        put(found, not last and room * ROOM >= size)
        if held >= OUT:
            yield batch()
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int | None = None, most: int = OPEN, window: int = WINDOW) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most `size` ids: (doc_id, piece, start, length, ids, sequence_id, offset).

    A document's ids are those of the tokenizer and end_id, if given; `ids` has a piece's as little-endian 32-bit numbers. A
    document longer than `size` is cut into pieces of `size`, the first of which is shorter where they don't come out even;
    `start` counts the ids before a piece in its document, `offset` those before it in its sequence, without gaps.

    Whole texts of any length are packed. Null texts count as empty; a document without ids (empty, and no end_id) has no
    piece. Repeated rows, ids and rows without an id are packed each by itself. Other columns are not looked at. Sequence
    ids are numbers with gaps. An empty table gives an empty one. The session hands Python small batches from then on.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        units, _ = tokenizer(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in tx.slices(batch.column(1), SLICE):
                tokens, first = units.ids(data, offsets)
                if end_id is not None:
                    tokens, first = np.insert(tokens, first[1:], end_id), first + np.arange(len(first))
                raw, edges = tokens.astype("<u4").tobytes(), first.tolist()
                for doc_id, s, e in zip(ids[a:b], edges[:-1], edges[1:]):
                    cut = min(e, s + ((e - s) % size or size))
                    piece, at = 0, s
                    while at < e:
                        yield doc_id, piece, at - s, raw[4 * at : 4 * cut]
                        piece, at, cut = piece + 1, cut, cut + size

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(coded(batches), size, most, window, TaskContext.get().partitionId() << 32, False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(4))))
        yield from _packed(pieces, size, most, window, (1 << 62) + (TaskContext.get().partitionId() << 32), True)

    rows = tx.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = written(rows.mapInArrow(once, _SCHEMA), "packed")
    left = packed.where("left")
    n_ids = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = left.repartition(n_ids // AGAIN + 1, "sequence_id", "offset").sortWithinPartitions("sequence_id", "offset")
    done = dealt.select("doc_id", "piece", "start", "ids").mapInArrow(again, _SCHEMA)
    return packed.where("not left").unionAll(done).drop("left")
