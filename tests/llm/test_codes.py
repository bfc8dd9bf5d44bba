"""Codes of vectors: the query, the heaps, and cases."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from geoweave.llm import codes
from geoweave.llm.registry import ORACLES, QUERIES


def lloyd(x: np.ndarray, parts: int, entries: int, rounds: int):
    """Plain rounds over whole-number rows in order of their ids."""
    cut, out, books = codes.edges(x.shape[1], parts), [], []
    for a, b in zip(cut, cut[1:]):
        part = x[:, a:b]
        book = part[:entries].copy()
        assign = lambda: ((part[:, None] - book[None]) ** 2).sum(axis=2)
        for _ in range(rounds):
            own = assign().argmin(axis=1)
            book = np.array([part[own == e].sum(axis=0) // (own == e).sum() if (own == e).any() else book[e] for e in range(len(book))])
        books.append(book)
        out.append(assign())
    return np.array([d.argmin(axis=1) for d in out]).T, sum(d.min(axis=1) for d in out), books


def test_codes_match_sql(spark, sql, same):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op12_vector_codes"](spark, folder).toPandas(), sql(folder, ORACLES["op12_vector_codes"]))


@pytest.mark.parametrize("rounds", [0, 1, 7])
def test_rounds_are_those_of_plain_lloyd(spark, rounds):
    """In several blocks, with clusters that move, ties and equal entries; most parts are not looked at in the last round."""
    rng = np.random.default_rng(rounds)
    x = np.concatenate([rng.normal(c, 30, (300, 12)) for c in (0, 400, -300, 50)]).astype(int)
    x[5] = x[3]
    x[700:760] = x[700]
    x = x[rng.permutation(len(x))]
    vectors = spark.createDataFrame([(i, i % 3 or None, r) for i, r in enumerate(x.tolist())], "vec_id long, label int, v array<bigint>").repartition(5)
    got, books = codes.code_vectors(vectors, parts=4, entries=9, rounds=rounds)
    wanted, error, wanted_books = lloyd(x, 4, 9, rounds)
    assert all((a == b).all() for a, b in zip(books, wanted_books))
    for r in got.collect():
        assert list(bytes(r.code)) == wanted[r.vec_id].tolist() and r.error == error[r.vec_id]


def test_a_round_pops_only_what_may_have_moved():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 20, (500, 3)) + 1000 * c for c in range(4)]).astype(float)
    book = x[::500] + 3
    heaps = codes.Heaps.all_in(len(x), 4)
    rows, _, after = heaps.round(x, book, np.zeros(4))
    assert len(rows) == len(x) and (heaps.owners() == np.repeat(range(4), 500)).all() and (after >= 0).all()
    rows, _, _ = heaps.round(x, book + 1, np.full(4, 2 * 3**0.5))
    assert len(rows) == 0
    rows, before, after = heaps.round(x, np.roll(book, 1, axis=0), np.full(4, 1e5))
    assert len(rows) == len(x) and (before != after).all()
    assert all((np.diff(heaps.keys[a:b]) >= 0).all() for a, b in zip(heaps.at, heaps.at[1:]))


def test_cases_of_codes(spark, tmp_path):
    v = [0.5, -0.25] * 16
    rows = [(3, v, None), (3, v, None), (None, v, 1), (4, None, 1), (5, [None, *v[1:]], 1), (6, [float("nan"), *v[1:]], 1), (7, [float("inf"), *v[1:]], 1), (8, v[:7], 1), (9, [1.0] * 32, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, v string, error string")
    coded, books = codes.code_vectors(codes.integer_vectors(table, 256.0))
    got = {(r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in codes.with_label_errors(coded).collect()}
    assert got == {(3, "00" * 16, 0, 0), (None, "00" * 16, 0, 0), (9, "02" * 16, 0, 0)}
    assert [len(b) for b in books] == [4] * 16
    none, books = codes.code_vectors(codes.integer_vectors(table.limit(0), 256.0))
    assert none.collect() == [] and books == []
    large = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        codes.code_vectors(codes.integer_vectors(large, 256.0))


def test_embeddings_with_repeated_rows_match_sql(spark, sql, same, tiny, tmp_path):
    table = pq.read_table(f"{tiny}/embeddings.parquet")
    import pyarrow as pa

    pq.write_table(pa.concat_tables([table, table.slice(3, 40)]), tmp_path / "embeddings.parquet")
    same(QUERIES["op12_vector_codes"](spark, str(tmp_path)).toPandas(), sql(str(tmp_path), ORACLES["op12_vector_codes"]))


def test_neighbours_with_clashing_columns(spark):
    """Tables whose other columns have the names of the operators' own: the results are those without them."""
    from geoweave.llm import knn

    rows = [(i, [float(i % 7) / 8, float(i % 5) / 8, 0.5, -0.25], i % 3) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    odd = plain.selectExpr("*", "'c' AS cell", "1 AS v", "2 AS far", "3 AS block", "4 AS code", "5 AS error", "6 AS keys", "7 AS ids")
    got = []
    for table in (plain, odd):
        vectors = knn.whole_vectors(table, 64.0)
        near = sorted(map(tuple, knn.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=5).collect()))
        coded, _ = codes.code_vectors(codes.integer_vectors(table, 256.0), parts=2, entries=8)
        got.append((near, sorted((r.vec_id, bytes(r.code), r.error) for r in coded.collect())))
    assert got[0] == got[1] and len(got[0][0]) == 15 and len(got[0][1]) == 60
