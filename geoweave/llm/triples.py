"""Interpolated modified Kneser-Ney model of word triples: the order three of ngram.py, with its tokens and discounts.

A first pass numbers the words, so that a triple is exact in 12 bytes. Map tasks sum the distinct triples of their texts
and send them to the bucket of the first two words, which writes its triples and contexts. It sends on each distinct
triple as one more word before the pair of the last two; the bucket of that pair sums these into its number n2, writes
the pairs, and sends on partial sums for either word. These meet in the bucket of the word. No step gathers by one word.

  p3(w|uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv) + g(uv) p2(w|v),  p2(w|v) = max(n2(vw) - E(n2(vw)), 0) / n2(v) + g(v) q(w)
with q(w) from the number of distinct words before w. Two begins stand before each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoweave.llm import files, ngram, text as tx
from geoweave.llm.ngram import HELD, _SENT, _batch, _counts, _send, bucket_of, discounts
from geoweave.shared import fresh_path, shuffle_partitions

U, W = np.uint64, np.uint32
#: Number of what stands before a text, and of words that the model has not seen. Numbers of words begin at 1.
BEGIN, UNSEEN = 0, 2**32 - 1
_SUMS = ["t1", "t2", "t3", "t4", "p1", "p2", "p3", "p4", "pairs", "w1", "w2", "w3", "w4", "words"]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(U) << U(32)) | b.astype(U)


def _of_key(key: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(tx.mix(key), buckets)


def _summed(first: np.ndarray, n: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of n."""
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    keys, n = [x[order] for x in ((first,) if second is None else (first, second))], n[order]
    head = np.ones(len(n), bool)
    head[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    head = np.flatnonzero(head)
    return *(x[head] for x in keys), (np.add.reduceat(n, head) if len(head) else n)


def _parts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs and its rows in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), order[edges[i] : edges[i + 1]]


def _halves(key: np.ndarray) -> bytes:
    return (key >> U(32)).astype(W).tobytes() + key.astype(W).tobytes()


def _whole(data: bytes) -> np.ndarray:
    return _joined(*np.frombuffer(data, W).reshape(2, -1))


def _read(table: pa.Table, kind: int, name: str, form: type, get=None) -> np.ndarray:
    rows = table.filter(pa.array(table.column("kind").to_numpy() == kind)).column(name).to_pylist()
    return np.concatenate([np.zeros(0, form), *((get(x) if get else np.frombuffer(x, form)) for x in rows)])


def _small(n: np.ndarray) -> list[np.ndarray]:
    """Numbers in a byte each, and those over 254 with their places."""
    more = np.flatnonzero(n > 254)
    return [np.minimum(n, 255).astype(np.uint8), more.astype(np.int64), n[more].astype(np.int64)]


def _at(small: tuple, at: np.ndarray) -> np.ndarray:
    low, more, large = small
    out = low[at].astype(np.int64)
    over = np.flatnonzero(out == 255)
    if len(over):
        out[over] = large[np.searchsorted(more, at[over])]
    return out


_SMALL = (np.uint8, np.int64, np.int64)


def count_words(buckets: int):
    """A mapInArrow function: text to packed counts of words (k: hashes, a: counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0

        def emit() -> pa.RecordBatch:
            key, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
            return _batch([_send(i, 0, key[at], n[at]) for i, at in _parts(bucket_of(key, buckets), buckets)])

        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                word = ngram.tokens(data, offsets)[1]
                parts.append(_summed(word, np.ones(len(word), np.int64)))
                held += len(parts[-1][0])
                if held > HELD:
                    yield emit()
                    parts, held = [], 0
        if parts:
            yield emit()

    return run


def merge_vocabulary(path: str):
    """An applyInArrow function for a bucket of hashes: writes its words and counts, gives their numbers."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, n = _summed(_read(table, 0, "k", U), _read(table, 0, "a", np.int64))
        files.put(f"{path}/vocabulary-{bucket}", files.pack(key, n))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "words": [len(key)], "tokens": [int(n.sum())]})

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Words by number: bucket i has those from first[i] on, in order of hash."""

    path: str
    first: np.ndarray
    tokens: int

    @property
    def buckets(self) -> int:
        return len(self.first) - 1

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted distinct hashes."""
        out, count = np.full(len(hashes), UNSEEN, W), np.zeros(len(hashes), np.int64)
        for i, mine in _parts(bucket_of(hashes, self.buckets), self.buckets):
            if self.first[i + 1] > self.first[i]:
                key, n = files.unpack(files.mapped(f"{self.path}/vocabulary-{i}"), U, np.int64)
                at = np.minimum(np.searchsorted(key, hashes[mine]), len(key) - 1)
                hit = key[at] == hashes[mine]
                out[mine[hit]], count[mine[hit]] = self.first[i] + at[hit], n[at[hit]]
        return out, count

    def bucket(self, number: np.ndarray) -> np.ndarray:
        """Where the sums of a word are kept; those of BEGIN in the first bucket."""
        return np.maximum(np.searchsorted(self.first, number, "right") - 1, 0)

    def place(self, bucket: int, number: np.ndarray) -> np.ndarray:
        """Place of a word in its bucket's sums; that of BEGIN is 0."""
        return np.where(number == BEGIN, 0, number.astype(np.int64) - self.first[bucket] + 1)


def numbered(words: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of some texts: numbers of the word two before, of the one before and of itself, its count, and where texts begin."""
    _, word, first = ngram.tokens(data, offsets)
    keys, back = np.unique(word, return_inverse=True)
    number, count = words.numbers(keys)
    word, begins = number[back], first[:-1]
    before = np.concatenate((np.zeros(1, W), word[:-1]))
    before[begins] = BEGIN
    two = np.concatenate((np.zeros(1, W), before[:-1]))
    two[begins] = BEGIN
    return two, before, word, count[back], first


def count_triples(words: Vocabulary, buckets: int):
    """A mapInArrow function: text to packed counts of triples (k: first two words, a: triples of each, b: words, c: counts)."""

    def emit(parts: list) -> pa.RecordBatch:
        context, word, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
        rows = []
        for i, at in _parts(_of_key(context, buckets), buckets):
            keys, runs = np.unique(context[at], return_counts=True)
            rows.append(_send(i, 0, _bytes(_halves(keys)), runs.astype(W), word[at], n[at].astype(W)))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                two, before, word, _, _ = numbered(words, data, offsets)
                context, word, n = _summed(_joined(two, before), np.ones(len(word), np.int64), word)
                parts.append((context, n, word))
                held += len(word)
                if held > HELD:
                    yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _bytes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


def merge_triples(path: str, buckets: int):
    """An applyInArrow function for a bucket of contexts: writes its triples, sends on words before pairs."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        context = np.repeat(_read(table, 0, "k", U, _whole), _read(table, 0, "a", W))
        context, word, n = _summed(context, _read(table, 0, "c", W).astype(np.int64), _read(table, 0, "b", W))
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        sums = [np.add.reduceat(x, head, dtype=np.int64) for x in (n, n == 1, n == 2)]
        files.put(f"{path}/triples-{bucket}", files.pack(context[head], np.append(head, len(n)).astype(W), *(y for x in sums for y in _small(x)), word, *_small(n)))
        pair, before = _summed(_joined(context.astype(W), word), np.ones(len(n), np.int64))
        rows = [_send(i, 1, _bytes(_halves(pair[at])), before[at].astype(W)) for i, at in _parts(_of_key(pair, buckets), buckets)]
        return pa.Table.from_batches([_batch([*rows, _send(bucket, 2, _counts(n))])])

    return run


def merge_pairs(path: str, words: Vocabulary, buckets: int):
    """An applyInArrow function for a bucket of pairs: writes their numbers of words before, sends on what the words need."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        pair, n = _summed(_read(table, 1, "k", U, _whole), _read(table, 1, "a", W).astype(np.int64))
        of_triples = _read(table, 2, "k", np.int64).reshape(-1, 4)
        rows = [_send(0, 5, np.concatenate((of_triples.sum(axis=0), _counts(n), [len(n)]))), _send(0, 6, np.array([bucket, len(of_triples), len(pair)]))]
        if len(pair):
            files.put(f"{path}/pairs-{bucket}", files.pack(pair, *_small(n)))
            context = (pair >> U(32)).astype(W)
            head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            sums = np.stack([np.add.reduceat(x, head, dtype=np.int64) for x in (n, n == 1, n == 2, n > 2)])
            for i, at in _parts(words.bucket(context[head]), words.buckets):
                rows.append(_send(i, 3, context[head][at], sums[:, at].T))
            word, before = np.unique(pair.astype(W), return_counts=True)
            for i, at in _parts(words.bucket(word), words.buckets):
                rows.append(_send(i, 4, word[at], before[at].astype(np.int64)))
        return pa.Table.from_batches([_batch(rows)])

    return run


def merge_words(path: str, words: Vocabulary):
    """An applyInArrow function for a bucket of words: writes their sums, gives those of the bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sums = np.zeros((5, int(words.first[bucket + 1] - words.first[bucket]) + 1), np.int64)
        np.add.at(sums[0], words.place(bucket, _read(table, 4, "k", W)), _read(table, 4, "a", np.int64))
        at = words.place(bucket, _read(table, 3, "k", W))
        for row, x in zip(sums[1:], _read(table, 3, "a", np.int64).reshape(-1, 4).T):
            np.add.at(row, at, x)
        files.put(f"{path}/words-{bucket}", files.pack(*sums))
        seen = sums[0][sums[0] > 0]
        of_all = _read(table, 5, "k", np.int64).reshape(-1, 9).sum(axis=0)
        put = [f"words-{bucket}"]
        for b, *has in _read(table, 6, "k", np.int64).reshape(-1, 3).tolist():
            put += [f"{name}-{b}" for name, n in zip(("triples", "pairs"), has) if n]
        return pa.table({n: [int(v)] for n, v in zip(_SUMS, (*of_all, *_counts(seen), len(seen)))} | {"files": [put]})

    return run


@dataclass(frozen=True)
class Model:
    """Where the files are, in how many buckets, the sums over all, and the files' names: one of them that is not there is an error."""

    path: str
    buckets: int
    words: Vocabulary
    sums: dict[str, int]
    names: frozenset[str]

    def _files(self, name: str, key: np.ndarray, bucket: np.ndarray, buckets: int, *types: type) -> Iterator[tuple]:
        for i, mine in _parts(bucket, buckets) if self.words.tokens else ():
            if f"{name}-{i}" in self.names:  # else nothing fell into this bucket
                yield i, mine, key[mine], files.unpack(files.mapped(f"{self.path}/{name}-{i}"), *types)

    def of_words(self, number: np.ndarray) -> np.ndarray:
        """Distinct words before each, and for the pairs that it begins: sum of n2, and pairs with n2 of 1, 2 and more."""
        out = np.zeros((5, len(number)), np.int64)
        seen = np.flatnonzero(number != UNSEEN)
        for i, mine, key, sums in self._files("words", number[seen], self.words.bucket(number[seen]), self.words.buckets, *[np.int64] * 5):
            at = self.words.place(i, key)
            for row, x in zip(out, sums):
                row[seen[mine]] = x[at]
        return out

    def of_pairs(self, pair: np.ndarray) -> np.ndarray:
        """Numbers of distinct words before pairs."""
        out = np.zeros(len(pair), np.int64)
        for _, mine, want, (key, *n) in self._files("pairs", pair, _of_key(pair, self.buckets), self.buckets, U, *_SMALL):
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
            out[mine[hit]] = _at(n, at[hit])
        return out

    def of_triples(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Count of each triple, and for its context: count, and triples seen once, twice and more often."""
        out = np.zeros((5, len(context)), np.int64)
        for _, mine, want, (key, start, *rest) in self._files("triples", context, _of_key(context, self.buckets), self.buckets, U, W, *_SMALL * 3, W, *_SMALL):
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
            if not len(hit):
                continue
            mine, at = mine[hit], at[hit]
            low, end = start[at].astype(np.int64), start[at + 1].astype(np.int64)
            for j in range(3):
                out[1 + j, mine] = _at(rest[3 * j : 3 * j + 3], at)
            out[4, mine] = end - low - out[2, mine] - out[3, mine]
            words, high = rest[9], end.copy()
            while (low < high).any():  # all searched side by side
                middle = (low + high) >> 1
                less = (low < high) & (words[np.minimum(middle, len(words) - 1)] < word[mine])
                high = np.where((low < high) & ~less, middle, high)
                low = np.where(less, middle + 1, low)
            found = np.flatnonzero((low < end) & (words[np.minimum(low, len(words) - 1)] == word[mine]))
            out[0, mine[found]] = _at(rest[10:], low[found])
        return out


def train(docs: DataFrame, buckets: int | None = None) -> Model:
    """The model of docs (text). More buckets make smaller files and tasks."""
    spark = tx.in_small_batches(docs).sparkSession
    path, buckets = fresh_path(spark, "triples"), buckets or shuffle_partitions(spark)
    docs = docs.select("text")
    sizes = docs.mapInArrow(count_words(buckets), _SENT).groupBy("bucket").applyInArrow(merge_vocabulary(path), "bucket int, words long, tokens long").collect()
    each = np.zeros(buckets, np.int64)
    for r in sizes:
        each[r["bucket"]] = r["words"]
    words = Vocabulary(path, 1 + np.concatenate(([0], np.cumsum(each))), sum(r["tokens"] for r in sizes))
    if words.first[-1] >= UNSEEN:
        raise ValueError("more than 2**32 - 2 distinct words")
    triples = docs.mapInArrow(count_triples(words, buckets), _SENT).groupBy("bucket").applyInArrow(merge_triples(path, buckets), _SENT)
    pairs = triples.groupBy("bucket").applyInArrow(merge_pairs(path, words, buckets), _SENT)
    sums = pairs.groupBy("bucket").applyInArrow(merge_words(path, words), ", ".join(f"{n} long" for n in _SUMS) + ", files array<string>")
    return Model(path, buckets, words, *ngram.totals(sums))


def scores(model: Model):
    """A mapInArrow function: (doc_id, held_out, text) to token counts, the base score and the model's score, log10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = model.sums, model.words.tokens
        v, pairs = s["words"], s["pairs"]
        d, e, f = (discounts(*(s[f"{x}{i}"] for i in range(1, 5))) for x in "tpw")
        rest = f[1] * s["w1"] + f[2] * s["w2"] + f[3] * (v - s["w1"] - s["w2"])
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(2)):
                two, before, word, count, first = numbered(model.words, data, offsets)
                keys, back = np.unique(np.concatenate((word, before)), return_inverse=True)
                left, total, once, twice, often = model.of_words(keys)
                q = (np.maximum(left - f[np.minimum(left, 3)], 0) + rest / (v + 1)) / pairs if pairs else np.full(len(keys), 1 / (v + 1))
                of_word, of_before = back[: len(word)], back[len(word) :]
                pair, again = np.unique(_joined(before, word), return_inverse=True)
                n2, pick = model.of_pairs(pair)[again], of_before
                more = e[1] * once + e[2] * twice + e[3] * often
                p = np.where(total[pick] > 0, (np.maximum(n2 - e[np.minimum(n2, 3)], 0) + more[pick] * q[of_word]) / np.maximum(total[pick], 1), q[of_word])
                c, total, once, twice, often = model.of_triples(_joined(two, before), word)
                p = np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + (d[1] * once + d[2] * twice + d[3] * often) * p) / np.maximum(total, 1), p)
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                columns = [np.diff(first), tx.per_text((count > 0).astype(np.int64), first), np.full(b - a, n, np.int64), tx.per_text(base, first), tx.per_text(np.log10(p), first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, columns)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run
