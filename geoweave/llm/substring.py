"""Substring dedup: seeds on winnowed anchors, extended both ways to whole repeats.

Every window of `length` words selects one anchor, the k-gram of least hash in it, so equal windows have equal anchors
at equal places. An anchor's span is the union of the windows that select it: the longest text that its seeds must share.

1. Each task emits one row for each distinct (anchor, span) of a batch, with the occurrences it stands for.
2. The rows are joined by anchor, in sorted order. Occurrences whose whole span is also in a smaller document are
   repeats: the seed extends over the full span on both sides. Anchors that occur with other spans too are open.
3. Only for open spans' first documents, the windows themselves are compared, by 128-bit hashes: the seed extends over
   some of its windows.
4. Overlapping repeats merge into maximal ones, none shorter than `length`, and are cut from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.llm.neardup import maybe_in, id_filter, FILTER_BITS
from geoweave.shared import written

U = tx.U
#: A place in a text: 28 bits that tell texts of one id apart, 30 bits of first window, 6 bits of number of windows.
_WINDOW, _TEXT = 6, 36

#: Anchors that a task gathers before it sends them off.
HELD = 250_000


def anchors(words: tx.Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, span hash, text number, first window and number of windows, for each anchor of each text."""
    starts = np.arange(max(0, len(words) - length + 1))
    starts = starts[words.doc[starts] == words.doc[starts + length - 1]] if len(starts) else starts
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    every = np.arange(len(words) - k + 1)
    grams = words.spans(every, every + k)
    best, at = grams[starts], starts.copy()
    for j in range(1, length - k + 1):
        other = grams[starts + j]
        less = other < best
        best = np.where(less, other, best)
        at[less] = starts[less] + j
    head = np.ones(len(starts), bool)
    head[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(head)
    count = np.diff(np.append(head, len(starts)))
    first, at = starts[head], at[head]
    span = words.spans(first, first + count + length - 1)
    return tx.mix(best[head] ^ U(0xA5A5A5A5)), tx.mix(span ^ ((at - first).astype(U) << U(8)) ^ count.astype(U)), words.doc[first], first, count


def text_marks(words: tx.Words, offsets: np.ndarray) -> np.ndarray:
    return (tx.byte_spans(words.prefix, offsets[:-1], offsets[1:]) >> U(_TEXT)).astype(np.int64) << (_TEXT)


def seeds(length: int, k: int):
    """A mapInArrow function: doc_id and text to anchor, span, the batch's first occurrence of both, and `more` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in tx.slices(batch.column(1)):
                words = tx.Words(data, offsets)
                anchor, span, doc, first, count = anchors(words, length, k)
                place = text_marks(words, offsets)[doc] | (first - words.first[doc]) << _WINDOW | count
                parts.append(np.stack((anchor.view(np.int64), span.view(np.int64), ids[a:b][doc], place)))
                if sum(x.shape[1] for x in parts) > HELD:
                    yield from _gathered(parts)
                    parts = []
        yield from _gathered(parts)

    return run


def _gathered(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct anchor and span, in batches of some thousand."""
    rows = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    head = np.ones(rows.shape[1], bool)
    head[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    head = np.flatnonzero(head)
    end = np.append(head[1:], rows.shape[1])
    for at in range(0, len(head), 20_000):
        first, last = head[at : at + 20_000], end[at : at + 20_000]
        more = [rows[2:, i + 1 : j].T.tobytes() if j - i > 1 else None for i, j in zip(first.tolist(), last.tolist())]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in rows), pa.array(more, pa.binary())], names=["anchor", "span", "doc_id", "place", "more"])


_ROW = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("more", pa.binary())])
_HIT = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("open", pa.bool_())])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, span, doc_id: whole repeats, and the open places (see 2.).

    An anchor that occurs once is let go by array operations; the others pass one by one. Held back are only a batch's
    last row, and the places of one document that an anchor's first span has.
    """
    anchor_now = span_now = None
    least, first_span, held = 0, True, []
    waiting = pa.Table.from_batches([], _ROW)
    for batch in _then_none(batches):
        table = waiting if batch is None else pa.concat_tables([waiting, pa.Table.from_batches([batch]).cast(_ROW)])
        if not table.num_rows:
            continue
        anchor = table.column(0).to_numpy()
        keep = table.column(4).is_valid().to_numpy().copy()
        same = anchor[1:] == anchor[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= anchor[0] == anchor_now
        if batch is not None:  # whether the last row's anchor goes on shows in the next batch
            waiting, keep[-1] = table.slice(table.num_rows - 1), False
        hits = []
        for a, s, d, x, more in zip(*(c.to_pylist() for c in table.filter(pa.array(keep)).columns)):
            places = [(d, x)]
            if more is not None:
                places += np.frombuffer(more, np.int64).reshape(-1, 2).tolist()
            if a != anchor_now:
                anchor_now, span_now, least, first_span, held = a, s, d, True, []
            elif s != span_now:
                hits += held
                span_now, least, first_span, held = s, d, False, []
            for d, x in places:
                if d > least:
                    hits.append((d, x, False))
                else:
                    (held if first_span else hits).append((d, x, True))
        yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], t) for j, t in enumerate(_HIT.types)], schema=_HIT)


def _then_none(batches):
    yield from batches
    yield None


def windows(length: int):
    """A mapInArrow function: doc_id, text and places to the windows there, with 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in tx.slices(batch.column(1)):
                words = tx.Words(data, offsets)
                doc, first, count, mark = _places(batch.column(2).slice(a, b - a), text_marks(words, offsets), np.diff(words.first))
                doc, mark, first = np.repeat(doc, count), np.repeat(mark, count), tx.ranges(first, count)
                at = words.first[doc] + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.spans(at, at + length, salt).view(np.int64)) for salt in (0, 0x3C6EF372)] + [pa.array(ids[a:b][doc]), pa.array(mark | first << _WINDOW | 1)],
                    names=["h1", "h2", "doc_id", "place"],
                )

    return run


def _places(lists: pa.ListArray, marks: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """text number, first window, number of windows and mark of the listed places that are in these very texts."""
    values, ends = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    doc = np.repeat(np.arange(len(lists)), ends)
    mine = (values >> _TEXT) == (marks[doc] >> _TEXT)
    doc, values = doc[mine], values[mine]
    first, count = values >> _WINDOW & (2**30 - 1), values & 63
    inside = first + count <= n_words[doc]
    return doc[inside], first[inside], count[inside], marks[doc[inside]]


def repeats(docs: DataFrame, length: int = 13, k: int = 5) -> DataFrame:
    """(doc_id, places) for docs (doc_id, text): the windows of a document that also start in one with a smaller doc_id."""
    ids = docs.where("doc_id is not null")
    rows = ids.mapInArrow(seeds(length, k), "anchor long, span long, doc_id long, place long, more binary")
    found = written(rows.repartition("anchor").sortWithinPartitions("anchor", "span", "doc_id").mapInArrow(_extend, "doc_id long, place long, open boolean"), "repeats")
    asked = found.where("open").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    open_texts = maybe_in(ids, asked.select("doc_id"), "doc_id").join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places")
    seen = written(open_texts.mapInArrow(windows(length), "h1 long, h2 long, doc_id long, place long"), "windows")
    least = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    partly = seen.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "place")
    return found.where("not open").select("doc_id", "place").union(partly).groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def cut(length: int):
    """A mapInArrow function: doc_id, text, rest and places to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(1)):
                lists = batch.column(3).slice(a, b - a)
                raw = data.tobytes()
                texts = [raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                split = [t.split() for t in texts]
                n_words = np.array([len(w) for w in split], np.int64)
                removed, kept, digest = np.zeros(b - a, np.int64), [None] * (b - a), []
                masks: dict[int, np.ndarray] = {}
                if len(lists.flatten()):
                    words = tx.Words(data, offsets)
                    doc, first, count, _ = _places(lists, text_marks(words, offsets), n_words)
                    for i in np.unique(doc):
                        mine = doc == i
                        edge = np.zeros(n_words[i] + 1, np.int64)
                        np.add.at(edge, first[mine], 1)
                        np.add.at(edge, first[mine] + count[mine] + length - 1, -1)
                        keep = np.cumsum(edge)[:-1] == 0
                        masks[int(i)] = keep
                        removed[i] = len(keep) - keep.sum()
                for i, w in enumerate(split):
                    if removed[i]:
                        left = b" ".join(compress(w, masks[i].tolist()))
                        starts = words.start[words.first[i] : words.first[i + 1]]
                        stops = np.append(starts[1:], offsets[i + 1])
                        kept[i] = b"".join(raw[s:e] for s, e in zip(starts[masks[i]].tolist(), stops[masks[i]].tolist())).rstrip(b" \t\n\r\x0b\x0c")
                    else:
                        left, kept[i] = b" ".join(w), texts[i]
                    digest.append(sha256(left).hexdigest())
                rest = [c.slice(a, b - a) for c in (batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [rest[0], pa.array(kept, pa.binary()).cast(pa.string()), rest[1], pa.array(n_words), pa.array(removed), pa.array(digest, pa.string())],
                    names=["doc_id", "text", "rest", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def dedup_substrings(docs: DataFrame, length: int = 13, k: int = 5) -> DataFrame:
    """(doc_id, text, rest, n_words, n_removed, kept_sha256): documents without the words of repeated windows.

    A window is `length` consecutive words of one document; it is repeated if its words also start in a document with a
    smaller doc_id, as given. Kept words keep the white space after them; kept_sha256 is of the kept words joined by one
    space. rest: a struct of the other columns, whatever their names. Null texts count as empty and come out empty;
    rows that share a doc_id are not repeats of each other, rows without doc_id stay as they are. Very long texts are
    whole. An empty table gives an empty one.
    """
    assert 0 < k <= length and length - k < 63
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(0).alias("none")
    docs = tx.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    places = written(repeats(docs.select("doc_id", "text"), length, k), "places")
    maps = docs.sparkSession.sparkContext.broadcast(id_filter(places, "doc_id"))
    kind = docs.schema["rest"].dataType.simpleString()
    shape = docs.select("doc_id", "text", "rest")
    out = f"doc_id long, text string, rest {kind}, n_words long, n_removed long, kept_sha256 string"

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
            for n, m in maps.value.items():
                bits[(n - 1) * 4096 : n * 4096] = np.frombuffer(m, np.uint8)
            for batch in batches:
                s = batch.column(3).to_numpy()
                found = ((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["doc_id", "text", "rest"]).filter(pa.array(found if hit else ~found))

        return run

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both steps by the same worker."""
        none = lambda b: pa.array([None] * b.num_rows, pa.list_(pa.int64()))
        return cut(length)(pa.RecordBatch.from_arrays([*b.columns, none(b)], names=["doc_id", "text", "rest", "places"]) for b in split(False)(batches))

    spotted = docs.withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    touched = spotted.mapInArrow(split(True), shape.schema).join(places.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "rest", "places")
    return touched.mapInArrow(cut(length), out).union(spotted.mapInArrow(untouched, out))
