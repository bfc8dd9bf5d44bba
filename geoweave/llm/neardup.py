"""MinHash near-duplicates with odd sketches.

1. Texts with equal shingle sets are one class, found by a digest of the set; its smallest id stands for it.
2. Bands of MinHash values put similar classes into common buckets. Three rows in 20 bands miss a pair of similarity
   0.8 with probability (1 - 0.8**3)**20 < 1e-6.
3. Stars: each class is held against the least id of each of its buckets, first by odd sketches (parities of the MinHash
   samples, whose XOR population counts estimate high similarities), then exactly. Most groups hang together after that.
4. Rest: in buckets that still hold several components, sketches are compared across components, and what may be similar
   is tied to clusters. In a cluster all that is outside its commonest component is held exactly against all of it.
Both exact steps deal sets out to tiles of bounded size, and a tile gives only the links that join components, so no step
writes pairs of a group. No pair is left out: each pair that shares a bucket, passes the sketches and does not hang
together already is compared on its full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.llm.components import joined
from geoweave.shared import written

U = tx.U
BANDS, ROWS, SAMPLES, SKETCH_BITS = 20, 3, 512, 2048
#: Bits of the bitmap that spares texts without a part in a round their shuffle; a full one only spares less.
FILTER_BITS = 26
#: Shingles and sets in a block of a cluster; a tile holds two blocks. Sketches in a block of a bucket.
SHINGLES, SETS, SKETCHED = 1 << 19, 1 << 10, 1 << 12
#: Bytes of sets that a task takes at a time, whatever its tiles, and common shingles that it counts at a time.
HELD, COUNTED = 1 << 22, 1 << 20
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (2, max(SAMPLES, BANDS * ROWS)), dtype=U) * U(2) + U(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of a string column: first row, end row, their distinct shingles text after text, n + 1 offsets.

    Lower-cases A-Z. A text of fewer than k words is one shingle; one without words has none.
    """
    for a, b, data, offsets in tx.slices(column):
        words = tx.Words(data, offsets, lower=True)
        grams, at = words.grams(k)
        owner = words.doc[at]
        n = np.diff(words.first)
        short = np.flatnonzero((n > 0) & (n < k))
        grams = np.concatenate((grams, words.spans(words.first[short], words.first[short + 1])))
        owner = np.concatenate((owner, short))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[fresh], owner[fresh]
        yield a, b, grams, np.searchsorted(owner, np.arange(b - a + 1))


def least_hashes(grams: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values, a row for each sample; 0 for texts without shingles."""
    full = np.diff(first) > 0
    least = np.zeros((samples, len(full)), U)
    for i in range(samples if full.any() else 0):
        least[i, full] = np.minimum.reduceat((grams ^ _SEEDS[0, i]) * _SEEDS[1, i], first[:-1][full])
    return least


def digests(grams: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """128 bits that tell shingle sets apart."""
    return [pa.array(tx.per_text(tx.mix(grams ^ U(s)), first).view(np.int64)) for s in (0x51ED270B, 0x2545F491)]


def signatures(k: int):
    """A mapInArrow function: doc_id and text to the set's size and digest, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, first in shingle_sets(batch.column(1), k):
                least = least_hashes(grams, first, BANDS * ROWS)
                bands = np.zeros((b - a, BANDS), U)
                for j in range(BANDS):
                    key = np.full(b - a, U(j + 1))
                    for r in range(ROWS):
                        key = tx.mix(key * U(0x9E3779B97F4A7C15) ^ least[j * ROWS + r])
                    bands[:, j] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), *digests(grams, first), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def sketches(k: int):
    """A mapInArrow function: doc_id and text to the set's size, digest and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, first in shingle_sets(batch.column(1), k):
                least = least_hashes(grams, first, SAMPLES)
                spot = (tx.mix(least + (np.arange(SAMPLES, dtype=U)[:, None] << U(1))) % U(SKETCH_BITS)).astype(np.int64)
                parity = np.zeros((b - a, SKETCH_BITS), np.uint8)
                for i in range(SAMPLES):
                    parity[np.arange(b - a), spot[i]] ^= 1
                packed = [x.tobytes() for x in np.packbits(parity, axis=1)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), digests(grams, first)[0], pa.array(packed, pa.binary())], names=["doc_id", "n", "d1", "sketch"])

    return run


def most_bits(similarity: float) -> int:
    """XOR bits that a pair of this similarity exceeds with a probability of about 1e-7.

    Of SAMPLES values some differ (binomial) and flip two bits each; pairs of flips that meet cancel.
    """
    mean = 2 * SAMPLES * (1 - similarity)
    left = (1 - 2 / SKETCH_BITS) ** mean
    sampling = 2 * left * np.sqrt(SAMPLES * similarity * (1 - similarity))
    meeting = 2 * np.sqrt(mean * mean / 2 / SKETCH_BITS)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - left) + 5.5 * np.hypot(sampling, meeting)))


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XOR bits of sketches, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(len(column), -1)


def likely(percent: int):
    """A mapInArrow function on rows (a, b, n, m, sketch, other): the pairs (a, b) that sizes and sketches allow."""
    most = most_bits(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (unlike(sketch_rows(batch.column(4)), sketch_rows(batch.column(5))) <= most)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good))

    return run


def whole_tiles(batches: Iterator[pa.RecordBatch], weight: int | None, enough: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of tile (the first three columns) as tables of whole tiles, with the first row of each tile and the end.

    A table has at least `enough` rows, or bytes of column `weight`, but for the last; the tile that goes beyond is whole.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, size
        table = pa.Table.from_batches(held)
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for c in range(3):
            key = table.column(c).to_numpy()
            fresh[1:] |= key[1:] != key[:-1]
        edges = np.flatnonzero(fresh)
        end = table.num_rows if last else int(edges[-1])
        if end:
            yield table.slice(0, end), np.append(edges[edges < end], end)
            held, size = table.slice(end).to_batches(), 0

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows if weight is None else batch.column(weight).nbytes
            if size >= enough:
                yield from cut(False)
    if held:
        yield from cut(True)


def across(percent: int):
    """A mapInArrow function on rows (g, r, q, doc_id, label, hub, spoke, n, sketch) in order of tile (g, r, q).

    A tile's spokes are held against its hubs of other labels. Gives (a, b) for each id that sizes and sketches tie to
    another: b is the same for all ids that hang together so in the tile.
    """
    most = most_bits(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_tiles(batches, None, SKETCHED):
            ids, label, hub, spoke, n = (table.column(c).to_numpy() for c in range(3, 8))
            sketch = sketch_rows(table.column(8).combine_chunks())
            root, met = np.arange(len(ids)), np.zeros(len(ids), bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                hubs, part = a + np.flatnonzero(hub[a:b]), root[a:b]
                for i in (a + np.flatnonzero(spoke[a:b])).tolist():
                    j = hubs[(label[hubs] != label[i]) & (100 * np.minimum(n[hubs], n[i]) >= percent * np.maximum(n[hubs], n[i]))]
                    j = j[unlike(sketch[j], sketch[i]) <= most]
                    if len(j):
                        met[i] = met[j] = True
                        roots = np.unique(np.append(root[j], root[i]))
                        if len(roots) > 1:
                            part[np.isin(part, roots)] = roots[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(ids[root[met]])], names=["a", "b"])

    return run


def tied(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Labels that pairs of rows (i, j) join, as few pairs of labels as do it."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for a, b in np.unique(np.stack((label[i], label[j]), axis=1), axis=0).tolist() if len(i) else ():
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def alike(percent: int):
    """A mapInArrow function on rows (g, r, q, doc_id, label, hub, spoke, grams) in order of tile (g, r, q).

    A tile's spokes are held exactly against its hubs of other labels, by counting the shingles that they have in common.
    Gives pairs (a, b) of labels that hang together, as few as say so for the tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_tiles(batches, 7, HELD):
            label, hub, spoke = (table.column(c).to_numpy() for c in range(4, 7))
            raw = table.column(7).to_pylist()
            n = np.array([len(x) >> 3 for x in raw])
            first = np.cumsum(n) - n
            tile = np.repeat(np.arange(len(edges) - 1, dtype=U), np.diff(edges))
            grams = np.frombuffer(b"".join(raw), U) ^ tx.mix(np.repeat(tile, n) + U(1))  # shingles of other tiles differ
            rows = np.repeat(np.arange(len(n)), n)
            of_hub = hub[rows]
            known, owner = grams[of_hub], rows[of_hub]
            order = np.argsort(known)
            known, owner = known[order], owner[order]
            spokes = np.flatnonzero(spoke & (n > 0))
            asked = grams[tx.ranges(first[spokes], n[spokes])]
            low = np.searchsorted(known, asked, "left")
            met = np.searchsorted(known, asked, "right") - low
            begin = np.append(np.cumsum(n[spokes]) - n[spokes], len(asked))
            work = np.append(0, np.cumsum(met))[begin]  # common shingles before each spoke
            good_i, good_j, at = [], [], 0
            while at < len(spokes):
                end = max(at + 1, int(np.searchsorted(work, work[at] + COUNTED, "right")) - 1)
                here = slice(begin[at], begin[end])
                i = np.repeat(np.repeat(spokes[at:end], n[spokes[at:end]]), met[here])
                j = owner[tx.ranges(low[here], met[here])]
                pair, both = np.unique((i * len(n) + j)[label[i] != label[j]], return_counts=True)
                i, j = np.divmod(pair, len(n))
                good = 100 * both >= percent * (n[i] + n[j] - both)
                good_i.append(i[good])
                good_j.append(j[good])
                at = end
            links = tied(label, np.concatenate(good_i), np.concatenate(good_j)) if good_i else []
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def id_filter(ids: DataFrame, column: str) -> dict[int, bytes]:
    """Hashes of ids as bitmaps of 4 KB; at most 2**FILTER_BITS bits, whatever the number of ids."""
    spot = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS))
    rows = ids.select((spot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    return {r["k"]: bytes(r["m"]) for r in rows.collect()}


def maybe_in(docs: DataFrame, ids: DataFrame, column: str, then: Callable | None = None, shape: str | None = None) -> DataFrame:
    """docs (doc_id, text) whose id may be among ids: few others pass, unless the bitmap is full.

    then, a mapInArrow function of (doc_id, text) with rows of `shape`, is run on them by the same workers.
    """
    maps = docs.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for k, m in maps.value.items():
            bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(2).to_numpy()
                keep = (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

        return then(kept()) if then else kept()

    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    return docs.select("doc_id", "text", spot.alias("spot")).mapInArrow(run, shape or docs.select("doc_id", "text").schema)


TILE = ["g", "r", "q"]


def in_tiles(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (g, doc_id, label, ...) once for each tile (g, r, q) that they have a part in, as hub, as spoke or as both.

    blocks (g, most, hubs, spokes): how many blocks the hubs and the spokes of g are dealt to. All rows of g are hubs; the
    spokes are those whose label is not `most`, so two of the commonest label meet in vain only where they meet others.
    """
    dealt = rows.join(blocks, "g").withColumn("spoke", F.col("label") != F.col("most"))
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    one = (F.col("hubs") == 1) & (F.col("spokes") == 1)
    place = lambda r, q, hub, spoke: F.struct(r.alias("r"), q.alias("q"), hub.alias("hub"), spoke.alias("spoke"))
    as_hub = F.transform(every("spokes"), lambda q: place(part("hubs"), q, F.lit(True), F.lit(False)))
    as_spoke = F.transform(every("hubs"), lambda r: place(r, part("spokes"), F.lit(False), F.lit(True)))
    places = F.when(one, F.array(place(F.lit(0), F.lit(0), F.lit(True), F.col("spoke")))).otherwise(F.when(F.col("spoke"), F.concat(as_hub, as_spoke)).otherwise(as_hub))
    return dealt.withColumn("p", F.explode(places)).select("g", "p.r", "p.q", "doc_id", "label", "p.hub", "p.spoke", *[c for c in rows.columns if c not in ("g", "doc_id", "label")])


def block_numbers(rows: DataFrame, weight: Column, per_rows: int, per_weight: int) -> DataFrame:
    """blocks for in_tiles of the groups of rows (g, doc_id, label, ...) that hold more than one label."""
    by_label = rows.groupBy("g", "label").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    of = by_label.groupBy("g").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("labels > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / per_rows), F.ceil(w / per_weight), F.lit(1))
    return of.select("g", F.col("top.label").alias("most"), blocks(F.col("c"), F.col("w")).alias("hubs"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("spokes"))


def confirmed(docs: DataFrame, tiles: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between labels for tiles (g, r, q, doc_id, label, hub, spoke), on the full shingle sets of docs.

    A set is made once and goes to each tile of its document; a task holds about HELD bytes of sets, or one tile.
    """
    to = F.struct(*TILE, "label", "hub", "spoke")
    by_doc = tiles.groupBy("doc_id").agg(F.collect_list(to).alias("to"))
    texts = maybe_in(docs, tiles, "doc_id").join(by_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "to")
    names = [*TILE, "doc_id", "label", "hub", "spoke", "grams"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for a, b, grams, first in shingle_sets(batch.column(1), k):
                here = places.slice(a, b - a)
                many = np.asarray(here.value_lengths())
                row = np.repeat(np.arange(b - a), many)
                flat, raw, ids = here.flatten(), [grams[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist())], batch.column(0).slice(a, b - a)
                size = np.cumsum(np.diff(first)[row] * 8)
                at = 0
                while at < len(row):  # batches of a few MB, however many tiles a text goes to
                    end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 22), "right")))
                    some = flat.slice(at, end - at)
                    yield pa.RecordBatch.from_arrays(
                        [*[some.field(i) for i in range(3)], ids.take(pa.array(row[at:end])), *[some.field(i) for i in range(3, 6)], pa.array([raw[i] for i in row[at:end].tolist()], pa.binary())], names=names
                    )
                    at = end

    dealt = texts.mapInArrow(sets, "g long, r int, q int, doc_id long, label long, hub boolean, spoke boolean, grams binary")
    return dealt.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(alike(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id long, text string), by similarity of k-word shingle sets.

    Sets are compared as sets of 64-bit hashes. component_id is the smallest doc_id reachable over links; kept: it is the
    own one. Null and empty texts, and texts without words, have no shingles and link with nothing: their component is
    their own id. Rows that share a doc_id are one document: what links with one of its texts is linked with the others.
    Texts are taken whole, however long. A row without doc_id takes no part: component_id is null and it is kept.
    Columns beside doc_id and text are not looked at. An empty table gives an empty one.
    """
    docs = tx.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(docs.mapInArrow(signatures(k), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    shingled = sig.where("n_shingles > 0 and doc_id is not null")
    key = ["d1", "d2", "n_shingles"]
    classes = written(shingled.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    # one id with several texts ties their classes
    several = shingled.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo < hi").select("doc_id")
    ties = written(shingled.join(several, "doc_id", "left_semi").join(classes, key).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct(), "ties")
    labels = joined(None, ties)

    reps = shingled.join(classes.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi")
    banded = reps.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("bucket", "lo")
    buckets = written(banded.join(shared, "bucket"), "buckets")
    drawn = written(maybe_in(docs, buckets.select("doc_id"), "doc_id", sketches(k), "doc_id long, n long, d1 long, sketch binary").dropDuplicates(["doc_id", "d1"]).drop("d1"), "sketches")

    stars = buckets.select(F.col("doc_id").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()
    one, two = drawn.withColumnRenamed("doc_id", "a"), drawn.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    near = written(stars.join(one, "a").join(two, "b").select("a", "b", "n", "m", "sketch", "other").mapInArrow(likely(percent), "a long, b long").distinct(), "stars")
    sizes = near.groupBy(F.col("b").alias("g")).agg(F.ceil(F.count("*") / SETS).cast("int").alias("parts"))
    dealt = near.withColumnRenamed("b", "g").join(sizes, "g").select("g", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("q"), F.col("a").alias("doc_id"), F.lit(False).alias("hub"))
    dealt = dealt.union(sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), F.col("g").alias("doc_id"), F.lit(True).alias("hub")))
    tiles = written(dealt.select("g", F.lit(0).alias("r"), "q", "doc_id", F.col("doc_id").alias("label"), "hub", (~F.col("hub")).alias("spoke")), "star-tiles")
    labels = joined(labels, written(confirmed(docs, tiles, k, percent), "star-links"))

    named = lambda rows: rows.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    rows = written(named(buckets.select(F.col("bucket").alias("g"), "doc_id")), "labelled")
    blocks = written(block_numbers(rows, F.lit(0), SKETCHED, 1), "bucket-blocks")
    dealt = in_tiles(rows, blocks).join(drawn, "doc_id").select(*TILE, "doc_id", "label", "hub", "spoke", "n", "sketch")
    met = written(dealt.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(across(percent), "a long, b long").distinct(), "met")
    if met.limit(1).count():
        clusters = joined(None, met).select(F.col("node").alias("doc_id"), F.col("label").alias("g"))
        rows = written(named(clusters).join(drawn.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"), "clusters")
        tiles = written(in_tiles(rows.drop("n"), block_numbers(rows, F.col("n"), SETS, SHINGLES)), "tiles")
        labels = joined(labels, written(confirmed(docs, tiles, k, percent), "links"))

    tops = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("top"))
    return (
        sig.select("doc_id", *key).join(tops, key, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
