"""Vectors as short codes: a codebook for each part of a vector, fitted by Lloyd's rounds over heaps.

Vectors lie in blocks. A block keeps, for each part and codebook entry, a heap of the parts that the entry is nearest to,
keyed by their slack: the distance to the second nearest entry (a lower bound for all others) minus that to the nearest (an
upper bound), plus the entry's drift at that time. When entries move, an entry's drift grows by its own way and the longest way
of another: a part's bounds can be violated only if its key is not above that sum. So a round pops those parts, compares
them exactly with all entries and pushes them where they belong; the others are not looked at. Sums for the new entries
are changed by the parts that moved. Drifts, entries and sums are all that passes through the driver: a set number of them.

A heap is held as an array in the order of its keys, which is a heap; popping all up to a bound takes its head, and pushing
some is one merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from geoweave.llm import text as tx
from geoweave.shared import written

#: Components may not be larger, so that squared distances are exact.
LARGEST = 1 << 22
#: Added to a drift for rounding; distances are at most 2**28, and their roots exact to 2**-24.
MARGIN = 1e-6


def edges(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and the end; equal parts if its length is a multiple of their number."""
    return [length * p // parts for p in range(parts + 1)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows; exact below 2**53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None]


class Heaps:
    """A block's heaps for one part: entry e's keys and rows are those from at[e] to at[e + 1]."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, at: np.ndarray):
        self.keys, self.rows, self.at = keys, rows, at

    def owners(self) -> np.ndarray:
        """Each row's entry."""
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        return out

    def round(self, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pops what may be violated and pushes it where it belongs: the rows, the entries they had and those they have."""
        n = len(entries)
        heads = np.array([np.searchsorted(self.keys[a:b], drift[e] + MARGIN, "right") for e, (a, b) in enumerate(zip(self.at, self.at[1:]))])
        popped = tx.ranges(self.at[:-1], heads)
        rows, before = self.rows[popped], np.repeat(np.arange(n), heads)
        after, slack = nearest(x[rows], entries)
        keys = slack + drift[after]
        order = np.lexsort((rows, keys, after))
        first = np.searchsorted(after[order], np.arange(n + 1))
        new_keys, new_rows = [], []
        for e in range(n):
            k, r = self.keys[self.at[e] + heads[e] : self.at[e + 1]], self.rows[self.at[e] + heads[e] : self.at[e + 1]]
            pushed = order[first[e] : first[e + 1]]
            place = np.searchsorted(k, keys[pushed])
            new_keys.append(np.insert(k, place, keys[pushed]))
            new_rows.append(np.insert(r, place, rows[pushed]))
        self.at = np.append(0, np.cumsum(list(map(len, new_keys))))
        self.keys, self.rows = np.concatenate(new_keys), np.concatenate(new_rows)
        return rows, before, after

    @classmethod
    def all_in(cls, n: int, entries: int) -> Heaps:
        """n rows that no bound holds for yet."""
        return cls(np.full(n, -np.inf), np.arange(n, dtype=np.int32), np.append(0, np.full(entries, n)))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the least, and how much farther the second is."""
    far = squares(x, entries)
    best = far.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    rows = np.arange(len(x))
    least = far[rows, best]
    far[rows, best] = np.inf
    return best, np.sqrt(far.min(axis=1, initial=np.inf)) - np.sqrt(least)


def _bytes(arrays: list[np.ndarray], kind: str) -> bytes:
    return np.concatenate([np.zeros(0, kind), *arrays]).astype(kind).tobytes()


class Block:
    """Some vectors' ids and labels, their components as n rows, and the heaps of each part."""

    SCHEMA = "ids array<long>, labels array<{}>, vectors binary, keys binary, rows binary, at binary, moved array<long>"
    NAMES = ["ids", "labels", "vectors", "keys", "rows", "at", "moved"]

    def __init__(self, ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps]):
        self.ids, self.labels, self.x, self.heaps = ids, labels, x, heaps
        self.moved = np.zeros(0, np.int64)

    def round(self, books: list[np.ndarray], drifts: list[np.ndarray]) -> Block:
        """One assignment; `moved` has by how much it changes the sums and counts of each entry, part by part."""
        cut, moved = edges(self.x.shape[1], len(books)), []
        for p, (heaps, entries, drift) in enumerate(zip(self.heaps, books, drifts)):
            x, n = self.x[:, cut[p] : cut[p + 1]], len(entries)
            fresh = np.isneginf(heaps.keys).any()
            rows, before, after = heaps.round(x, entries, drift)
            other = np.ones(len(rows), bool) if fresh else before != after
            change = np.zeros((n, x.shape[1] + 1))
            for j, column in enumerate([*x[rows[other]].T, np.ones(int(other.sum()))]):
                change[:, j] = np.bincount(after[other], column, n) - (0 if fresh else np.bincount(before[other], column, n))
            moved.append(change.ravel())
        self.moved = np.rint(np.concatenate(moved)).astype(np.int64)
        return self

    def record(self) -> pa.RecordBatch:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [one(self.ids), one(self.labels), pa.array([self.x.astype("<i4").tobytes()]), pa.array([_bytes([h.keys for h in self.heaps], "<f8")])]
        columns += [pa.array([_bytes([h.rows for h in self.heaps], "<i4")]), pa.array([_bytes([h.at for h in self.heaps], "<i4")]), one(pa.array(self.moved))]
        return pa.RecordBatch.from_arrays(columns, names=self.NAMES)

    @classmethod
    def of_record(cls, batch: pa.RecordBatch, i: int, parts: int, entries: int) -> Block:
        ids, labels = (batch.column(c)[i].values for c in (0, 1))
        read = lambda c, kind, shape: np.frombuffer(batch.column(c)[i].as_py(), kind).reshape(shape)
        keys, rows, at = read(3, "<f8", (parts, -1)), read(4, "<i4", (parts, -1)), read(5, "<i4", (parts, entries + 1))
        return cls(ids, labels, read(2, "<i4", (len(ids), -1)).astype(float), [Heaps(*h) for h in zip(keys, rows, at.astype(np.int64))])


def integer_vectors(table: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v) for table (vec_id, embedding, label): floor(scale * x) of each component as long.

    Vectors that are null, or hold null or non-finite components, are left out. A component out of the range of LARGEST is an error.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(F.floor(c * scale)) <= LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for a code")).cast("long"))
    return table.where(F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, whole).alias("v"))


def code_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors (vec_id, label, v), and the codebooks, an array of whole-number entries for each part.

    A vector is cut into consecutive parts. A part's codebook starts as that part of the vectors with the least vec_ids
    (null last, ties by their components; all vectors, if fewer than `entries`). Each round gives every part its nearest
    entry, ties to the least, and replaces each entry by its parts' mean, rounded down; entries without parts stay. At last parts
    are assigned again. Gives (vec_id, label, code, error): the entries' numbers in part order, a byte each, and the squared
    distances to them, summed. Rows count as often as they stand there.

    Only vectors as long as the first have a code, others are left out; where the length is no multiple of `parts`, part p
    begins at component length * p // parts. Other columns are not looked at. An empty table gives an empty one and no codebook.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    spark, vectors = vectors.sparkSession, tx.in_small_batches(vectors.select("vec_id", "label", "v"))
    kind = StructType([StructField("label", vectors.schema["label"].dataType)])
    label = kind["label"].dataType.simpleString()
    schema, coded = Block.SCHEMA.format(label), f"vec_id long, label {label}, code binary, error long"
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return spark.createDataFrame([], coded), []
    length = len(first[0].v)
    drawn = np.array([r.v for r in first if len(r.v) == length], float).reshape(-1, length)
    if len(drawn) < len(first):  # of those as long as the first
        vectors = vectors.where(F.size("v") == length)
        drawn = np.array([r.v for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()], float).reshape(-1, length)
    cut, n = edges(length, parts), len(drawn)
    books = [drawn[:, a:b] for a, b in zip(cut, cut[1:])]
    drifts = [np.zeros(n) for _ in books]

    def begin(batches: Iterator[pa.RecordBatch], books: list, drifts: list) -> Iterator[Block]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, length).astype(float)
            yield Block(batch.column(0), batch.column(1), x, [Heaps.all_in(len(x), n) for _ in books]).round(books, drifts)

    def go_on(batches: Iterator[pa.RecordBatch], books: list, drifts: list) -> Iterator[Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield Block.of_record(batch, i, parts, n).round(books, drifts)

    def records(step, books: list, drifts: list):
        return lambda batches: (block.record() for block in step(batches, books, drifts))

    def codes(step, books: list, drifts: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in step(batches, books, drifts):
                owners = np.array([h.owners() for h in block.heaps]).T
                near = np.concatenate([book[own] for book, own in zip(books, owners.T)], axis=1)
                code = pa.array([c.tobytes() for c in owners.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([block.ids, block.labels, code, pa.array(((block.x - near) ** 2).sum(axis=1).astype(np.int64))], names=["vec_id", "label", "code", "error"])

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for moved in batch.column(0):
                total = total + moved.values.to_numpy()
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], names=["moved"])

    held, step = vectors.where(F.size("v") == length), begin
    sums = np.zeros(n * (length + parts), np.int64)
    for k in range(rounds):
        held = written(held.mapInArrow(records(step, books, drifts), schema), f"code-blocks-{k}")
        moved = held.select("moved").mapInArrow(summed, "moved array<long>").select(F.posexplode("moved").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        for i, x in moved.collect():  # entries * (length + parts) numbers
            sums[i] += x
        old, books, drifts, at = books, [], [d.copy() for d in drifts], 0
        for p, book in enumerate(old):
            size = n * (book.shape[1] + 1)
            total, at = sums[at : at + size].reshape(n, -1), at + size
            used = total[:, -1] > 0
            new = np.where(used[:, None], total[:, :-1] // np.maximum(total[:, -1:], 1), book)
            way = np.sqrt(((new - book) ** 2).sum(axis=1))
            two = np.append(np.sort(way)[::-1], [0, 0])[:2]
            drifts[p] += way + np.where(way == two[0], two[1] if (way == two[0]).sum() == 1 else two[0], two[0])
            books.append(new.astype(float))
        step = go_on
    return held.mapInArrow(codes(step, books, drifts), coded), [b.astype(np.int64) for b in books]


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


#: Parts into which the rows of one label are dealt where a sum over them is joined back.
SALT = 32


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (written) with label_error: error summed over the rows of equal label, nulls together."""
    by = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).alias("salt")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    sums = sums.withColumnRenamed("label", "of")
    rows = coded.withColumn("salt", by)
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"]) & (rows["salt"] == sums["salt"])).select(*coded.columns, "label_error")
