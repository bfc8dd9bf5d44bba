"""A small folder of tables with the cases that need a defined result."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def texts() -> list:
    rng = random.Random(7)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("sen", "dor", "vil", "pra", "qu", "xi")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(90), prose(60)
    near = base.split()
    near[40] = "changed"
    out = [
        base, base, " ".join(near), base.upper(), None, "", " \t\n ", "one", "one", "three short words", "a b c d", "a  b\tc\nd",
        prose(40) + "\n" + passage + "\n" + prose(30), prose(20) + " " + passage, passage, passage + " " + passage,
        "the " * 200, "x y z w v " * 30, "line one here\nline one here\n\n \nline two\nline one here",
        "$$$ %%% ### &&& " * 20, "WOW!! SO!! MUCH!! NOISE!! " * 12, "été élève naïve café " * 5 + prose(20), "  lead and trail  ", "don't we'll I'm 123 4567 <|endoftext|> a b 　c  d\n\n\ne",
        prose(15) + " Released under the MIT License. " + prose(15), "Licensed under the Apache License, Version 2.0.\n" + prose(30), "LICENSED under CC BY-NC 4.0 " + prose(12),
        " ".join(prose(9) for _ in range(400)),
    ]
    return out + [prose(rng.randint(5, 60)) for _ in range(30)]


@pytest.fixture(scope="session")
def tiny(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiny")
    t = texts()
    ids = list(range(10, 10 + len(t)))
    source = [None if i % 11 == 0 else f"src{i % 5}" if i % 3 else "src0" for i in ids]
    docs = {"doc_id": ids, "text": t, "lang": ["en"] * len(t), "source": source, "n_chars": [len(x or "") for x in t], "n_words": ["clash"] * len(t), "rest": [1] * len(t), "bucket": ["b"] * len(t)}
    pq.write_table(pa.table(docs).cast(pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("n_words", pa.string()), ("rest", pa.int64()), ("bucket", pa.string())])), folder / "documents.parquet")
    rng = random.Random(3)
    vectors = [[rng.randint(-3, 3) / 8 for _ in range(8)] for _ in range(90)] + [None, [1.0, None] + [0.0] * 6, [float("nan")] + [0.0] * 7, [0.0] * 8]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), folder / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([0 if x and ("$" in x or "!!" in x or x.startswith("the the")) else 1 for x in t], pa.int32()), "toxic": pa.array([0] * len(t), pa.int32())}), folder / "labels.parquet")
    turns = [(c, i, "user" if i and i % 2 else None, rng.choice(["a", "b", "", None])) for c in range(40) for i in [None, *range(rng.randint(0, 9))]]
    columns = dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns))))
    pq.write_table(pa.table(columns, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tiny, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "labels", "conversations"):
        pq.write_table(pq.read_table(f"{tiny}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)
