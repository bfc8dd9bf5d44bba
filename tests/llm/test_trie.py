"""The trie of conversations: the query, cases, and scans in many tasks."""

import random
from collections import defaultdict
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from geoweave.llm import trie
from geoweave.llm.registry import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list, base, taken) -> list:
    """Nodes by walking a tree of dicts."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(base(c), [])[: taken(c)] + v[taken(c) :]) for c, v in own.items()}
    members = defaultdict(list)
    for c, path in sorted(built.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in convs if built[c] == node)
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[0], x[1]))


def fives(c: int) -> int:
    return c - c % 5


def crc_9(c: int) -> int:
    return crc32(str(c).encode()) % 9


def nodes_of(spark, rows: list, tmp_path) -> list:
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("place", F.lit(0)).withColumn("task", F.lit(0)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    return sorted((tuple(r) for r in got.collect()), key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, tmp_path, seed):
    """Few different turns, so that paths meet and part at many depths; nulls, turns without number, and conversations without turns."""
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, i, i]), rng.choice(["user", "bot", None]), rng.choice(["a", "é b", "", None])) for c in rng.sample(range(200), 90) for i in range(rng.randint(1, 10))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) + [(None, 1, "user", "x")]
    assert nodes_of(spark, rows, tmp_path) == plain(rows, fives, crc_9)


def test_long_and_common_conversations(spark, tmp_path, monkeypatch):
    """One conversation with a third of the rows, many equal ones, one that each goes on from the last; more tasks than groups."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(5, i, "user", f"turn {i % 7}") for i in range(400)]
    rows += [(100 + 5 * c, i, "bot", "same") for c in range(60) for i in range(4)]
    rows += [(1000 + 5 * c, i, "user", f"step {i}") for c in range(20) for i in range(c)]
    rows += [(2001, 1, "user", "no base")]
    assert nodes_of(spark, rows, tmp_path) == plain(rows, fives, crc_9)


def test_sizes_match_sql(spark, sql, same):
    folder = "/root/testdata/sf0.01"
    same(QUERIES["op13_prefix_trie"](spark, folder).toPandas(), sql(folder, ORACLES["op13_prefix_trie"]))


def test_ties_repeated_rows_and_very_long_texts(spark, sql, same, tmp_path):
    rows = [(10, 1, "user", "b"), (10, 1, "user", "a"), (10, 1, "user", "a"), (11, None, None, None), (11, None, None, None), (15, 1, "user", "word " * 200_000), (20, 1, "user", "word " * 200_000)]
    nodes_of(spark, rows, tmp_path)
    same(QUERIES["op13_prefix_trie"](spark, str(tmp_path)).toPandas(), sql(str(tmp_path), ORACLES["op13_prefix_trie"]))


def test_places_are_preorder(spark):
    paths = {3: "ab", 1: "abc", 2: "abd", 7: "b", 4: "", 9: "abdx", 5: "ac"}
    turns = [(c, i + 1, ord(x), 0, 1, len(p)) for c, p in paths.items() for i, x in enumerate(p)]
    turns = spark.createDataFrame(turns, "conv_id long, depth long, a long, b long, size long, length long")
    convs = spark.createDataFrame([(c, len(p)) for c, p in paths.items()], "conv_id long, length long")
    nodes = {r.place: r for r in trie.prefix_trie(turns, convs).collect()}
    assert sorted(nodes) == list(range(8))
    seen: list = []
    for place in range(8):
        r = nodes[place]
        seen = [x for x in seen if x.subtree_end >= place]
        assert r.depth == len(seen) and r.parent_conv_id == (seen[-1].conv_id if seen else None)
        seen.append(r)


def test_scans_go_on_from_task_to_task(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 9)) for g, n in ((1, 3), (2, 300), (3, 1), (4, 1), (9, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, x long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.g, r.i): (r.x, r.least) for r in trie.scanned(df, ["g"], ["i"], ["i"], ["x"], "scan", first="i").collect()}
        whole = {(r.g, r.i): r.x for r in trie.scanned(df, [], ["g", "i"], ["g", "i"], ["x"], "scan", modulus=17).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in {r[0] for r in rows}:
        for i, total in enumerate(accumulate(x for a, _, x in rows if a == g)):
            assert got[g, i] == (total, 0)
    assert [whole[g, i] for g, i, _ in rows] == [t % 17 for t in accumulate(x for *_, x in rows)]
