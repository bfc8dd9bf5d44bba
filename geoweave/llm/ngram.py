"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and read by workers from mapped files.

Tokens are words with A-Z in lower case, then one end of text. Map tasks count the distinct pairs of their texts and
send them, sorted and packed, to the bucket of the pair's context; contexts that begin a large share of all pairs are
dealt to all buckets by the whole pair. Each bucket merges its pairs into a file of sorted hashes and counts, and sends on
what the word table needs: for each context the numbers of words seen once, twice and more often after it; for each word
the number of distinct contexts before it and its count. These are added up in the bucket of the word, which becomes a
second file. Only sums over all buckets come to the driver.

Which contexts are dealt out is told from a sample of the texts. It decides where pairs are counted, never whether: any
choice gives the same model. A file keeps 40 bits of a pair's hash besides its bucket, so a pair that was never seen is
taken for one of the n in its bucket with a probability of n / 2**40, one in ten thousand for a hundred million pairs.

  p(w|h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) q(w),  q(w) = max(n(w) - E(n(w)), 0) / pairs + g / (V + 1)
with n(w) the number of distinct contexts of w, D and E the three modified discounts of either level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoweave.llm import files, text as tx
from geoweave.shared import fresh_path, shuffle_partitions

U = tx.U
BEGIN, END = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)
#: Distinct pairs that a task holds before it sends them off.
HELD = 3_000_000
_SENT = "bucket int, kind int, k binary, a binary, b binary, c binary"
_SUMS = ["p1", "p2", "p3", "p4", "pairs", "w1", "w2", "w3", "w4", "words", "tokens"]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def pair_buckets(context: np.ndarray, key: np.ndarray, buckets: int, common: np.ndarray) -> np.ndarray:
    """The bucket of pairs: that of the context, or of the whole pair's key if the context is one of common (sorted)."""
    out = bucket_of(context, buckets)
    if len(common):
        hot = common[np.minimum(np.searchsorted(common, context), len(common) - 1)] == context
        out[hot] = bucket_of(tx.mix(key[hot]), buckets)
    return out


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mix(context * U(0x9FB21C651E98DF25) + word)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of some texts, and the n + 1 positions where each text's tokens begin."""
    words = tx.Words(data, offsets, lower=True)
    return np.insert(words.hash, words.first[:-1], BEGIN), np.insert(words.hash, words.first[1:], END), words.first + np.arange(len(offsets))


def _summed(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of context and word, and the sums of n."""
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    head = np.ones(len(word), bool)
    head[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    head = np.flatnonzero(head)
    return context[head], word[head], np.add.reduceat(n, head) if len(head) else n


def _send(bucket: int, kind: int, k: np.ndarray, a=b"", b=b"", c=b"") -> dict:
    return {"bucket": bucket, "kind": kind} | {n: x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for n, x in (("k", k), ("a", a), ("b", b), ("c", c))}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(("bucket", "kind", "k", "a", "b", "c"), kinds)], names=["bucket", "kind", "k", "a", "b", "c"])


def common_contexts(docs: DataFrame, buckets: int, fraction: float) -> np.ndarray:
    """Contexts that begin more than a quarter of a bucket's share of the pairs of a sample of docs (text), sorted: at most 4 * buckets."""
    least = 1 / (4 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                context, _, _ = tokens(data, offsets)
                keys, n = np.unique(context, return_counts=True)
                some = n >= least / 4 * len(context)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[some], U(0)).view(np.int64)), pa.array(np.append(n[some], 0)), pa.array(np.append(np.zeros(some.sum(), np.int64), len(context)))], names=["context", "n", "all"])

    counted = docs.sample(fraction, seed=5).mapInArrow(run, "context long, n long, all long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = counted.agg(F.sum("all").alias("all"))
    rows = counted.drop("all").join(F.broadcast(total)).where((F.col("n") > 0) & (F.col("n") >= least * F.col("all"))).select("context").collect()
    return np.sort(np.array([r["context"] for r in rows], np.int64).view(U))


def count_pairs(buckets: int, common: np.ndarray):
    """A mapInArrow function: text to packed counts of pairs (k: contexts, a: pairs of each, b: words, c: counts)."""

    def emit(parts: list) -> pa.RecordBatch:
        context, word, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
        bucket = pair_buckets(context, pair_key(context, word), buckets, common)
        if len(common):  # else they are in order already
            order = np.argsort(bucket, kind="stable")
            context, word, n, bucket = context[order], word[order], n[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for i in np.flatnonzero(np.diff(edges)):
            at = slice(edges[i], edges[i + 1])
            keys, runs = np.unique(context[at], return_counts=True)
            rows.append(_send(int(i), 0, keys, runs.astype(np.uint32), word[at], n[at].astype(np.uint32)))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                context, word, _ = tokens(data, offsets)
                parts.append(_summed(context, word, np.ones(len(word), np.int64)))
                held += len(parts[-1][0])
                if held > HELD:
                    yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def merge_pairs(path: str, buckets: int):
    """An applyInArrow function for a bucket of contexts: writes its pairs, sends on what the word table needs."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        context = np.repeat(np.concatenate(read("k", U)), np.concatenate(read("a", np.uint32)))
        context, word, n = _summed(context, np.concatenate(read("b", U)), np.concatenate(read("c", np.uint32)).astype(np.int64))
        key = pair_key(context, word)
        order = np.argsort(key)
        key, count = key[order], n[order]
        high, more = (key >> U(32)).astype(np.uint32), np.flatnonzero(count > 254)
        run_of = np.diff(np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1], [True]))))
        files.put(f"{path}/pairs-{bucket}", files.pack(high, (key >> U(24)).astype(np.uint8), np.minimum(count, 255).astype(np.uint8), more.astype(np.int64), count[more], run_of.max(keepdims=True)))
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        after = [np.add.reduceat(n == i if i < 3 else n > 2, head, dtype=np.int64).astype(np.uint32) for i in (1, 2, 3)]
        home, rows = bucket_of(context[head], buckets), []
        for i in np.unique(home).tolist():
            rows.append(_send(i, 1, context[head][home == i], *(x[home == i] for x in after)))
        rows.append(_send(bucket, 3, np.concatenate((_counts(n), [len(n)]))))
        order = np.argsort(word, kind="stable")
        word, n = word[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        before, total, word = np.diff(np.append(head, len(word))), np.add.reduceat(n, head), word[head]
        edges = np.searchsorted(bucket_of(word, buckets), np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(edges)):
            at = slice(edges[i], edges[i + 1])
            rows.append(_send(int(i), 2, word[at], before[at].astype(np.uint32), total[at].astype(np.uint64)))
        return pa.Table.from_batches([_batch(rows)])

    return run


def merge_words(path: str):
    """An applyInArrow function for a bucket of words: writes the word table, gives the bucket's sums and which files it has."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds = table.column("kind").to_numpy()

        def read(kind: int, name: str, form: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, form), *(np.frombuffer(x, form) for x in table.filter(pa.array(kinds == kind)).column(name).to_pylist())])

        key, back = np.unique(np.concatenate((read(2, "k", U), read(1, "k", U))), return_inverse=True)
        sums = np.zeros((5, len(key)), np.int64)
        words = len(read(2, "k", U))
        np.add.at(sums[0], back[:words], read(2, "b", np.uint64).astype(np.int64))
        np.add.at(sums[1], back[:words], read(2, "a", np.uint32).astype(np.int64))
        for i, name in enumerate(("a", "b", "c")):
            np.add.at(sums[2 + i], back[words:], read(1, name, np.uint32))
        files.put(f"{path}/words-{bucket}", files.pack(key, sums[0], *(s.astype(np.uint32) for s in sums[1:])))
        seen = sums[1][sums[1] > 0]
        of_pairs = read(3, "k", np.int64).reshape(-1, 5).sum(axis=0)
        put = [f"words-{bucket}"] + [f"pairs-{bucket}"] * bool((kinds == 3).any())
        return pa.table({n: [int(v)] for n, v in zip(_SUMS, (*of_pairs, *_counts(seen), len(seen), sums[0].sum()))} | {"files": [put]})

    return run


SUMMED = ", ".join(f"{n} long" for n in _SUMS) + ", files array<string>"


def totals(sums: DataFrame) -> tuple[dict[str, int], frozenset[str]]:
    """The sums over all buckets, and the names of their files: a few for each bucket."""
    names = [n for n in sums.columns if n != "files"]
    row = sums.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.flatten(F.collect_list("files")).alias("files")).first().asDict()
    return row, frozenset(row.pop("files"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2, and 3 or more lose; counts of counts that are 0 leave the plain discount or a half."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    each = [min(max((i - (i + 1) * y * above / n) if n else y, 0.05), i * 0.95) for i, n, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *each])


@dataclass(frozen=True)
class Model:
    """Where the files are, in how many buckets, the sums over all, the contexts whose pairs are in all buckets, and the files' names.

    A bucket that nothing fell into has no file; one of those named that is not there is an error.
    """

    path: str
    buckets: int
    sums: dict[str, int]
    common: np.ndarray
    names: frozenset[str]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """For sorted distinct keys: count, distinct contexts before, and words once, twice and more often after."""
        out = np.zeros((5, len(keys)))
        edges = np.searchsorted(bucket_of(keys, self.buckets), np.arange(self.buckets + 1))
        for i in np.flatnonzero(np.diff(edges)) if self.sums["tokens"] else ():
            if f"words-{i}" not in self.names:
                continue
            key, *columns = files.unpack(files.mapped(f"{self.path}/words-{i}"), U, np.int64, *[np.uint32] * 4)
            mine = keys[edges[i] : edges[i + 1]]
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = key[at] == mine
            for row, column in zip(out, columns):
                row[edges[i] : edges[i + 1]] = np.where(hit, column[at], 0)
        return out

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        out = np.zeros(len(word), np.int64)
        key = pair_key(context, word)
        bucket = pair_buckets(context, key, self.buckets, self.common)
        order = np.lexsort((key, bucket))
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for i in np.flatnonzero(np.diff(edges)) if self.sums["tokens"] else ():
            if f"pairs-{i}" not in self.names:
                continue
            high, low, count, more, large, longest = files.unpack(files.mapped(f"{self.path}/pairs-{i}"), np.uint32, np.uint8, np.uint8, np.int64, np.int64, np.int64)
            mine = order[edges[i] : edges[i + 1]]
            want, small = (key[mine] >> U(32)).astype(np.uint32), (key[mine] >> U(24)).astype(np.uint8)
            at, found = np.searchsorted(high, want), np.zeros(len(mine), np.int64)
            for j in range(int(longest[0])):  # equal upper halves stand side by side
                near = np.minimum(at + j, len(high) - 1)
                hit = (high[near] == want) & (low[near] == small) & (at + j < len(high))
                found[hit] = count[near[hit]]
                over = np.flatnonzero(hit & (found == 255))
                if len(over):
                    found[over] = large[np.searchsorted(more, near[over])]
            out[mine] = found
        return out


def train(docs: DataFrame, buckets: int | None = None, fraction: float = 0.01) -> Model:
    """The model of all docs (text). More buckets make smaller files and tasks; common contexts are looked for in a fraction of docs."""
    spark = tx.in_small_batches(docs).sparkSession
    path, buckets = fresh_path(spark, "ngrams"), buckets or shuffle_partitions(spark)
    common = common_contexts(docs.select("text"), buckets, fraction)
    counted = docs.select("text").mapInArrow(count_pairs(buckets, common), _SENT)
    merged = counted.groupBy("bucket").applyInArrow(merge_pairs(path, buckets), _SENT)
    sums = merged.groupBy("bucket").applyInArrow(merge_words(path), SUMMED)
    sums, names = totals(sums)
    return Model(path, buckets, sums, common, names)


def scores(model: Model):
    """A mapInArrow function: (doc_id, held_out, text) to token counts, the base score and the model's score, log10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.sums
        n, v, pairs = s["tokens"], s["words"], s["pairs"]
        d, e = discounts(s["p1"], s["p2"], s["p3"], s["p4"]), discounts(s["w1"], s["w2"], s["w3"], s["w4"])
        rest = e[1] * s["w1"] + e[2] * s["w2"] + e[3] * (v - s["w1"] - s["w2"])
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(2)):
                context, word, first = tokens(data, offsets)
                keys, back = np.unique(np.concatenate((word, context)), return_inverse=True)
                count, before, once, twice, often = model.words(keys)
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                q = (np.maximum(before - e[np.minimum(before, 3).astype(int)], 0) + rest / (v + 1)) / pairs if pairs else np.full(len(keys), 1 / (v + 1))
                of_word, of_context = back[: len(word)], back[len(word) :]
                both, again = np.unique(np.stack((of_context, of_word), axis=1).astype(np.int32).view(np.int64).ravel(), return_inverse=True)
                both = both.view(np.int32).reshape(-1, 2)
                h, w = both[:, 0], both[:, 1]
                c = model.pairs(keys[h], keys[w])
                # a context's count is the number of pairs it begins
                total = np.where(keys[h] == BEGIN, _begins(model), count[h])
                left = d[1] * once + d[2] * twice + d[3] * often
                p = np.where((once + twice + often)[h] > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + left[h] * q[w]) / np.maximum(total, 1), q[w])
                known = (count > 0).astype(np.int64)
                length = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(length),
                        pa.array(tx.per_text(known[of_word], first)),
                        pa.array(np.full(b - a, n, np.int64)),
                        pa.array(tx.per_text(base[of_word], first)),
                        pa.array(tx.per_text(np.log10(p)[again], first)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _begins(model: Model) -> float:
    """Number of texts learned from: the ends among the tokens."""
    return float(model.words(np.array([END]))[0, 0])


def score_texts(docs: DataFrame, learn: DataFrame, buckets: int | None = None, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs (doc_id, held_out, text).

    order is 2 (pairs) or 3 (triples). learn (text) is what the model learns from, all of it. Null texts count as empty: one token, the end; texts of any length are scored whole. Rows that are
    repeated count as often as they stand there. A model of no text gives every token 1 / (V + 1) = 1. Other columns of docs,
    whatever their names, are not looked at. An empty docs gives an empty table.
    """
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string"))
    if order == 3:
        from geoweave.llm import triples  # it takes tokens and discounts from here

        return rows.mapInArrow(triples.scores(triples.train(learn, buckets)), out)
    if order != 2:
        raise ValueError("order is 2 or 3")
    return rows.mapInArrow(scores(train(learn, buckets)), out)
