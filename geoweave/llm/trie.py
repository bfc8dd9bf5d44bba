"""The trie of conversations' prefixes, its nodes numbered in preorder.

A prefix is told by its depth and the sums of two hashes of its turns at their places (62 bits each). A node's name is its least
member; name and depth tell the node, and the nodes of one name lie on one path, a *chain*. Children ordered by their
names make a lexicographic order of the paths, in which a chain stands in a row and is followed by the chains that leave
it, the deeper first. So chains are ranked by the names on their paths; a node's place is where its chain begins plus its
depth in it, and its subtree ends at the last place where a conversation through it ends. The leaves and savings of a
subtree are differences of running sums over the places.

All running sums and names are scans over rows dealt by ranges: a task scans its own rows, and one row of each task tells
what goes on in the next. So a turn, a conversation or a node that a third of all rows belongs to may lie in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.shared import shuffle_partitions, written

U = np.uint64
#: Hashes of prefixes are taken modulo this.
MODULUS = 1 << 62
#: Ids that are joined to one piece of text.
PIECE = 8192


def _starts(keys: list[np.ndarray], n: int) -> np.ndarray:
    """Which of n rows differ from the one before in any key."""
    out = np.zeros(n, bool)
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def scanned(df: DataFrame, by: list[str], order: list[str], keep: list[str], sums: list[str], name: str, first: str | None = None, modulus: int = 0) -> DataFrame:
    """df's columns keep, with running sums of the columns sums (this row's included) in each group of `by`, in `order`.

    With `first`, a column `least` has that column's value in the group's first row. by (longs) and sums hold no nulls.
    Through the driver goes a row for each task: what its last group comes to.
    """
    columns = list(dict.fromkeys([*by, *keep, *sums, *([first] if first else [])]))
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by, *order).sortWithinPartitions(*by, *order).select(*columns)
    carried = ["least"] * bool(first)
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes if n not in sums), *(f"{s} long" for s in [*sums, *carried]), "task int, tail boolean"])
    out_names = [c for c in columns if c not in sums] + sums + carried + ["task", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group, totals, least, held = TaskContext.get().partitionId(), None, [U(0)] * len(sums), 0, None

        def out(held: list, tail: bool) -> pa.RecordBatch:
            tails = np.zeros(len(held[0]), bool)
            tails[-1] = tail
            return pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(tails), task, np.int32)), pa.array(tails)], names=out_names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(columns.index(c)).to_numpy()
            keys = [column(c) for c in by]
            start = _starts(keys, n)
            start[0] = group != [k[0] for k in keys]
            begins, nth = np.flatnonzero(start), np.cumsum(start)  # nth 0: the batch before's last group
            done = []
            for j, c in enumerate(sums):
                values = column(c).view(U)
                run_ = np.cumsum(values, dtype=U)
                run_ -= np.concatenate(([U(0) - totals[j]], (run_ - values)[begins]))[nth]
                totals[j] = run_[-1]
                done.append(pa.array((run_ % U(modulus) if modulus else run_).view(np.int64)))
            if first:
                leasts = np.concatenate(([least], column(first)[begins]))[nth]
                least = leasts[-1]
                done.append(pa.array(leasts))
            group = [k[-1] for k in keys]
            if held:
                yield out(held, False)
            held = [batch.column(i) for i, c in enumerate(columns) if c not in sums] + done
        if held:
            yield out(held, True)

    local = written(rows.mapInArrow(run, schema), name)
    going, before = [], None
    for t in local.where("tail").select("task", *by, *sums, *carried).orderBy("task").collect():
        group, totals = list(t[1 : 1 + len(by)]), list(t[1 + len(by) : 1 + len(by) + len(sums)])
        if before:
            going.append([t.task, *before[0], *before[1], *before[2]])
        if before and before[0] == group:
            totals = [a + b for a, b in zip(totals, before[1])]
            totals = [x % modulus for x in totals] if modulus else totals
            before = (group, totals, before[2])
        else:
            before = (group, totals, list(t[1 + len(by) + len(sums) :]))
    names = [f"on_{c}" for c in ["task", *by, *sums, *carried]]
    going_on = df.sparkSession.createDataFrame(going, ", ".join(f"{c} long" for c in names))
    same = F.col("task") == F.col("on_task")
    for c in by:
        same = same & (F.col(c) == F.col(f"on_{c}"))
    added = [F.col(s) + F.coalesce(f"on_{s}", F.lit(0)) for s in sums]
    added = [(x % modulus if modulus else x).alias(s) for x, s in zip(added, sums)]
    rows = local.join(F.broadcast(going_on), same, "left")  # a row for each task
    return rows.select(*dict.fromkeys([*by, *keep]), *added, *([F.coalesce("on_least", "least").alias("least")] if first else []))


def ordered_turns(table: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, size) for table (conv_id, turn, role, text): places from 1 in the order of turn, null first.

    a and b are a digest of role and text, null being empty, and size the text's bytes. Turns of one number are ordered
    by that digest; repeated rows are turns of their own. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = tx.in_small_batches(table).where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", part(1).alias("a"), part(16).alias("b"), F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("place"))
    return scanned(rows, ["conv_id"], ["turn", "a", "b"], ["a", "b", "size"], ["place"], "turns")


def rebuilt(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others do: the first `taken` turns of conversation `base`, then the own turns after as many.

    turns: see ordered_turns; base and taken: functions of conv_id. Of a shorter base all turns are taken, of one that is not
    there none. Gives turns (conv_id, depth, a, b, size, length) and conversations (conv_id, length), the turnless ones too.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("taken", taken)
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    got = F.least("taken", F.coalesce("has", F.lit(0)))
    convs = sizes.join(of_base, "base", "left").select("conv_id", "base", "taken", got.alias("got"), (got + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length"))
    convs = written(convs, "conversations")
    own = turns.join(convs, "conv_id").where(F.col("place") > F.col("taken")).select("conv_id", (F.col("got") + F.col("place") - F.col("taken")).alias("depth"), "a", "b", "size", "length")
    begun = convs.where("got > 0").select(F.col("conv_id").alias("of"), "base", "got", "length")
    lent = turns.join(begun, (turns["conv_id"] == begun["base"]) & (turns["place"] <= begun["got"]))
    lent = lent.select(F.col("of").alias("conv_id"), F.col("place").alias("depth"), "a", "b", "size", "length")
    return own.unionAll(lent), convs.select("conv_id", "length")


def _digests(stops: DataFrame) -> DataFrame:
    """(least, depth, ends_sha256) for stops (least, depth, conv_id): SHA-256 of a node's ids in ascending order, joined by commas.

    Ids are joined to pieces where they lie, dealt by ranges; a node's pieces are digested one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, depth, ids = (batch.column(i).to_numpy() for i in range(3))
            start = _starts([least, depth], len(ids))
            start[:1] = True
            begins = np.flatnonzero(start)
            edges = [i for a, b in zip(begins, np.append(begins[1:], len(ids))) for i in range(a, b, PIECE)]
            words = list(map(str, ids.tolist()))
            texts = [",".join(words[a:b]) for a, b in zip(edges, [*edges[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(least[edges]), pa.array(depth[edges]), pa.array(ids[edges]), pa.array(texts, pa.string())], names=["least", "depth", "at", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for least, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if node == (least, depth):
                    state.update(b"," + text.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (least, depth), sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["least", "depth", "ends_sha256"])
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["least", "depth", "ends_sha256"])

    n = shuffle_partitions(stops.sparkSession)
    dealt = stops.select("least", "depth", "conv_id").repartitionByRange(n, "least", "depth", "conv_id").sortWithinPartitions("least", "depth", "conv_id")
    joined = dealt.mapInArrow(pieces, "least long, depth long, at long, text string")
    return joined.repartition(n, "least", "depth").sortWithinPartitions("least", "depth", "at").mapInArrow(digest, "least long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: a row for each distinct sequence of first turns, the root's of none.

    turns: (conv_id, depth, a, b, size, length), depth from 1 to the conversation's length without gaps; equal turns have equal
    a, b and size. convs: (conv_id, length) of each conversation, the turnless ones too. Gives conv_id (the node's least
    member), depth, parent_conv_id (the parent's least member; null for the root), n_convs (members), n_children, n_leaves
    and saved (over the node's subtree: nodes without children, and (n_convs - 1) * size of their last turns), ends_sha256
    (of the members with just these turns), and place and subtree_end in preorder.

    A conversation of any length is taken whole, and one without turns belongs to the root. No conversations give no node.
    The names on a chain's path are gathered: at most one for each conversation of less id on which the path lies.
    """
    hashed = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "a", "b", "depth"), F.lit(MODULUS))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("size"), "length")
    rows = turns.select(roots.columns).unionAll(roots).withColumn("p", hashed(1)).withColumn("q", hashed(2))
    prefixes = scanned(rows, ["conv_id"], ["depth"], ["depth", "size", "length"], ["p", "q"], "prefixes", modulus=MODULUS)
    named = scanned(prefixes, ["depth", "p", "q"], ["conv_id"], ["conv_id", "size", "length"], [], "nodes", first="conv_id")

    # chains: where each name begins on each path, and the names above it
    on = named.groupBy("conv_id", "least").agg(F.min("depth").alias("top"), F.max("length").alias("length"))
    paths = on.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("top", "least"))).alias("path"), F.max("length").alias("length"))
    last = F.element_at("path", -1)
    chains = paths.where(last["least"] == F.col("conv_id")).select(
        F.col("conv_id").alias("least"), last["top"].alias("top"), "length", F.get("path", F.size("path") - 2)["least"].alias("parent"),
        F.transform("path", lambda x: F.struct((-x["top"]).alias("t"), x["least"].alias("l"))).alias("key"), (F.col("length") - last["top"] + 1).alias("until"),
    )
    chains = scanned(chains, [], ["key"], ["least", "top", "length", "parent"], ["until"], "chains")
    chains = chains.withColumn("begin", F.col("until") - (F.col("length") - F.col("top") + 1)).drop("until")
    leaving = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("least"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("n_leaving"))

    # each conversation's last place, and so each subtree's
    stops = named.where(F.col("depth") == F.col("length")).select("conv_id", "least", "depth")
    ends = stops.join(chains, "least").select("conv_id", (F.col("begin") + F.col("depth") - F.col("top")).alias("end"))
    nodes = named.join(ends, "conv_id").groupBy("least", "depth").agg(F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("end").alias("subtree_end"))
    nodes = nodes.join(chains, "least").join(leaving, ["least", "depth"], "left").select(
        "least", "depth", F.when(F.col("depth") > F.col("top"), F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "subtree_end",
        ((F.col("depth") < F.col("length")).cast("long") + F.coalesce("n_leaving", zero)).alias("n_children"), (F.col("begin") + F.col("depth") - F.col("top")).alias("place"), ((F.col("n_convs") - 1) * F.col("size")).alias("saves"),
    )
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "leaves": (F.col("n_children") == 0).cast("long"), "saved": F.col("saves")})
    keep = ["least", "depth", "parent_conv_id", "n_convs", "subtree_end", "n_children", "place", "saves", "leaf"]
    nodes = scanned(nodes, [], ["place"], keep, ["leaves", "saved"], "places")
    upto = nodes.where("leaf = 1").select(F.col("place").alias("subtree_end"), F.col("leaves").alias("leaves_at_end"), F.col("saved").alias("saved_at_end"))
    out = nodes.join(upto, "subtree_end").join(_digests(stops), ["least", "depth"], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_at_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_at_end") - F.col("saved") + F.col("saves")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "place", "subtree_end",
    )
