"""Exact top-k search by inner product: a Voronoi join.

Vectors are grouped by their nearest pivot. A group of queries has a radius U: every query is its pivot p plus at most U, so
a vector x scores at most p.x + U|x| with all of them. Summaries of the data give each group the vectors that lie best along
its pivot; the k-th best score that a query has with those, each id counted once, is one that it surely reaches, and the
least of a group's is the group's bound. Only vectors whose upper bound reaches it are sent to the group, whole cells at once
where their pivot and radius rule them out. Groups are solved in blocks, and the blocks' best are merged.

Vectors that lie nearly at right angles to each other have U near |x| and rule out nothing: then every vector goes to every
group. Whole numbers travel in 16 bits where they fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from geoweave.llm import text as tx
from geoweave.shared import written

#: Queries that a group has on average, queries in one task, and data vectors in one block.
GROUP, CHUNK, BLOCK = 512, 1024, 32_768
#: At most so many pivots, drawn from the queries by least hash.
PIVOTS = 256
#: For k wanted, vectors along a pivot whose scores give its group's bound: at most so many times k + 1.
SAMPLE = 3


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as 16 bits each after a 0 byte where they fit, else as doubles after a 1."""
    small = not x.size or (np.abs(x).max() < 1 << 15 and (x == np.rint(x)).all())
    return b"\0" + x.astype("<i2").tobytes() if small else b"\1" + x.astype("<f8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if raw[0] else "<i2", offset=1).astype(float)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    lists = [unpacked(x) for x in column.to_pylist()]
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed; exact for whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * d < 2**53:
        return a @ b.T
    return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)


def _greatest(bound: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In each row the n greatest bounds of distinct ids, and those ids; where there are fewer, -inf stands last."""
    order = np.lexsort((-bound, ids), axis=1)
    bound, ids = np.take_along_axis(bound, order, axis=1), np.take_along_axis(ids, order, axis=1)
    bound[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    order = np.argsort(-bound, axis=1)[:, :n]
    return np.take_along_axis(bound, order, axis=1), np.take_along_axis(ids, order, axis=1)


def whole_vectors(table: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v) for table (vec_id, embedding): floor(scale * x) of each component, packed.

    Vectors that are null, or hold null or non-finite components, and rows without vec_id are left out.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            values = np.floor(flat * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def routed(queries: DataFrame, data: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """What top_k solves: queries (cell, chunk, block, vec_id, v) and packed data (cell, chunk, block, ids, vectors, d); None if there is nothing."""
    queries = tx.in_small_batches(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = queries.count(), data.count()
    if not n or not m:
        return None
    drawn = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, -(-n // GROUP))).toArrow()
    pivots = _matrix(drawn.column("v").combine_chunks())
    blocks = -(-m // BLOCK)

    def to_pivots(x: np.ndarray) -> np.ndarray:
        d = max(x.shape[1], pivots.shape[1])
        square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None]
        return np.sqrt(np.maximum(square - 2 * _dot(x, pivots), 0)) + 1e-6 * d

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = to_pivots(_matrix(batch.column(1)))
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["vec_id", "v", "cell", "far"])

    shape = "vec_id long, v binary, cell int, far double"
    grouped = queries.mapInArrow(cells, shape)
    spread = {r["cell"]: (r["u"], r["n"]) for r in grouped.groupBy("cell").agg(F.max("far").alias("u"), F.count("*").alias("n")).collect()}
    radius = np.array([spread.get(i, (0.0, 0))[0] for i in range(len(pivots))])
    chunks = np.array([-(-spread.get(i, (0, 0))[1] // CHUNK) for i in range(len(pivots))])
    celled = data.mapInArrow(cells, shape)

    width, wanted = np.sqrt((pivots * pivots).sum(axis=1)), SAMPLE * (k + 1)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a task that score best with each pivot."""
        best, of = np.full((len(pivots), 0), -np.inf), np.zeros((len(pivots), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
                score = _dot(pivots, x).astype(float)
                best, of = _greatest(np.concatenate((best, score), axis=1), np.concatenate((of, np.broadcast_to(ids, score.shape)), axis=1), wanted)
        cell, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(of[cell, at]), pa.array(best[cell, at])], names=["cell", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "vec_id"))
    scores = data.mapInArrow(along, "cell int, vec_id long, score double").groupBy("cell", "vec_id").agg(F.max("score").alias("score"))
    tried = scores.withColumn("place", place).where(F.col("place") <= wanted).select("cell", "vec_id")
    tried = written(tried, "along-pivots")
    # of rows that share an id the least counts; at most PIVOTS * SAMPLE * (k + 1) vectors
    rows = data.join(F.broadcast(tried.select("vec_id").distinct()), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    samples = rows.join(tried, "vec_id").select("cell", "vec_id", "v").toArrow()
    sample = {int(i): (samples.filter(pa.compute.equal(samples.column("cell"), i))) for i in pa.compute.unique(samples.column("cell")).to_pylist()}
    sample = {i: (t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks())) for i, t in sample.items()}

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group the least of the scores that its queries surely reach."""
        least = np.full(len(pivots), np.inf)
        for batch in batches:
            if batch.num_rows:
                own, cell, q = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1))
                for i in np.unique(cell):
                    ids, x = sample.get(int(i), (np.zeros(0, np.int64), np.zeros((0, 0))))
                    mine = cell == i
                    score = np.where(own[mine, None] == ids[None], -np.inf, _dot(q[mine], x).astype(float))
                    least[i] = min(least[i], -np.inf if len(ids) < k else np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k].min())
        some = np.flatnonzero(least < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(least[some])], names=["cell", "bound"])

    least = np.full(len(pivots), -np.inf)
    for r in grouped.mapInArrow(reached, "cell int, bound double").groupBy("cell").agg(F.min("bound").alias("bound")).collect():  # a number for each pivot
        least[r["cell"]] = r["bound"] - 1e-6 * abs(r["bound"]) - 1e-6 if np.isfinite(r["bound"]) else -np.inf

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the groups that need it, packed: (group, chunk, block, ids, vectors)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell, far = (batch.column(i).to_numpy() for i in (0, 2, 3))
            x = _matrix(batch.column(1))
            norm = np.sqrt((x * x).sum(axis=1))
            between = _dot(pivots, pivots).astype(float)
            reach = np.zeros(len(pivots))
            np.maximum.at(reach, cell, far)
            block = (np.abs(ids * np.int64(0x9E3779B1)) >> 7) % blocks
            rows = []
            for i in np.flatnonzero(chunks):
                open_cell = between[i] + (width[i] + radius[i]) * reach + radius[i] * width >= least[i]
                may = np.flatnonzero(open_cell[cell])
                may = may[_dot(pivots[i : i + 1], x[may])[0] + radius[i] * norm[may] >= least[i]]
                for b in np.unique(block[may]):
                    mine = may[block[may] == b]
                    rows += [(int(i), c, int(b), ids[mine].tobytes(), packed(x[mine]), x.shape[1]) for c in range(chunks[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["cell", "chunk", "block", "ids", "vectors", "d"])

    dealt = celled.mapInArrow(deal, "cell int, chunk int, block int, ids binary, vectors binary, d int")
    counts = F.element_at(F.array(*[F.lit(int(max(c, 1))) for c in chunks]), F.col("cell") + 1)
    dealt = written(dealt, "dealt") if blocks > 1 else dealt
    some = dealt.select("cell", "chunk", "block").distinct() if blocks > 1 else None
    asked = grouped.select("cell", F.pmod(F.xxhash64("vec_id"), counts).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = asked if some is None else asked.join(some, ["cell", "chunk", "block"], "left_semi")  # none to a block without candidates
    return asked, dealt


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and data (vec_id, v): each query's k greatest inner products, or all.

    Ties go to the smaller vec_id; rows with the query's own vec_id are no candidates. A query row that is repeated counts
    once, and of different ones with one vec_id the least v in order of bytes; a data row counts as often as it stands
    there. Of vectors of unequal length the shorter one is filled with zeros. No queries or no data give an empty table.
    """
    both = routed(queries, data, k)
    if both is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, dealt = both

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows:
            own, q = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks())
            ids = [np.frombuffer(b, np.int64) for b in right.column("ids").to_pylist()]
            x = [unpacked(b).reshape(len(i), d) for i, b, d in zip(ids, right.column("vectors").to_pylist(), right.column("d").to_pylist())]
            ids = np.concatenate([np.zeros(0, np.int64), *ids])
            wide = max((a.shape[1] for a in x), default=0)
            x = np.concatenate([np.zeros((0, wide)), *(np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in x)])
            for at in range(0, len(own), 64):
                scores = _dot(q[at : at + 64], x)
                for i, row in zip(own[at : at + 64], scores):
                    other = np.flatnonzero(ids != i)
                    if len(other) > k:
                        kth = np.partition(row[other], len(other) - k)[len(other) - k]
                        other = other[row[other] >= kth]
                    other = other[np.lexsort((ids[other], -row[other]))][:k]
                    found.append((np.full(len(other), i), ids[other], row[other].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    keys = ["cell", "chunk", "block"]
    partial = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
