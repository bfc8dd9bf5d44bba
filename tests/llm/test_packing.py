"""Packing into sequences: pieces, places, bins and how full they are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from geoweave.llm.packing import Bins, pack_documents
from geoweave.llm.registry import QUERIES

PATH = P.path("byte_bpe_50k.json")


def pieces_of(ids: list, size: int) -> list:
    """(piece, start, ids) of a document by plain cutting."""
    first = len(ids) % size or min(size, len(ids))
    edges = [0, *range(first, len(ids) + 1, size)]
    return [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def gapless(rows, size: int) -> int:
    """How many sequences there are, each without gaps and at most `size` long."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(sequences)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("folder", ["tiny", "/root/testdata/sf0.001"])
def test_packing(spark, request, plain, folder):
    import pyarrow.parquet as pq

    folder = folder if folder.startswith("/") else request.getfixturevalue(folder)
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    rows = QUERIES["op11_best_fit_packing"](spark, folder).collect()
    wanted, total = [], 0
    for d in docs:
        ids = plain.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        wanted += [(d["doc_id"], k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, a, x in pieces_of(ids, 1024)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    assert gapless(rows, 1024) <= 1.02 * total / 1024 + 2


def test_cases_of_packing(spark, plain):
    rows = [(1, None), (1, None), (None, "a b c"), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (4, "x <|endoftext|> y")]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, piece int, sequence_id string").repartition(3)
    got = pack_documents(docs, PATH, size=64).collect()
    gapless(got, 64)
    wanted = [(d, k, a, x) for d, t in rows for k, a, x in pieces_of(plain.encode(t or "", add_special_tokens=False).ids, 64) if x]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got), key=lambda x: (x[0] or -1, *x[1:])) == sorted(wanted, key=lambda x: (x[0] or -1, *x[1:]))
    assert {r.doc_id for r in got} == {None, 3, 4}
    assert pack_documents(docs.limit(0), PATH, end_id=2).collect() == []


def slow_bins(lengths: list, size: int, most: int) -> list:
    """Bounded-space best-fit by looking at every open bin."""
    open_, done = [], []
    for i, x in enumerate(lengths):
        fits = [b for b in open_ if size - sum(lengths[j] for j in b) >= x]
        room = lambda b: size - sum(lengths[j] for j in b)
        if fits:
            found = min(reversed(fits), key=room)
        else:
            if len(open_) >= most:
                full = min(reversed(open_), key=room)
                open_.remove(full)
                done.append(full)
            found = []
        found.append(i)
        open_ = [b for b in open_ if b is not found]
        (open_ if room(found) else done).append(found)
    return done, open_


@pytest.mark.parametrize("most", [1, 3, 20])
def test_bins_do_as_a_search_of_all_of_them_does(most):
    rng = random.Random(most)
    lengths, bins, closed = [rng.randint(1, 50) for _ in range(600)], Bins(50, most), []
    for i, x in enumerate(lengths):
        closed += bins.place(x, i)
        assert bins.n <= most
    done, open_ = slow_bins(lengths, 50, most)
    assert [[i for _, i in b] for b in closed] == done
    assert sorted([i for _, i in b] for _, b in bins.rest()) == sorted(open_)


def test_what_tasks_leave_open_is_packed_again(spark, plain):
    """Many small tasks waste little: each leaves bins with room, and their pieces share sequences in the end."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "word " * rng.randint(1, 90)) for i in range(900)], "doc_id long, text string").repartition(30)
    rows = pack_documents(docs, PATH, size=128, end_id=2).collect()
    assert gapless(rows, 128) <= 1.03 * sum(r.length for r in rows) / 128
