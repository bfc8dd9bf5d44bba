"""Token ids in files of fixed-width packed bits.

A file holds documents in ascending order of doc_id: their ids, the positions where their tokens begin, the byte where
each block of BLOCK tokens begins, and the blocks. A token takes the fewest bits that hold every id of the vocabulary;
a block starts at a whole byte, so any range of tokens is read from the blocks that hold it and unpacked by array
operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from geoweave.llm import files, text as tx
from geoweave.llm.units import SLICE, Table, Units
from geoweave.shared import fresh_path, shuffle_partitions, written

BLOCK = 1 << 16
#: Tokens after which a task begins another file.
FILE_TOKENS = 1 << 24


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids, each in `bits` bits (1 to 32), least significant first, as bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").view(np.uint8)
    n = -(-len(ids) // 8)
    groups = np.zeros((n, 8), np.uint64)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((n, bits + 8), np.uint8)
    for j in range(8):  # the j-th id of every group
        byte, shift = divmod(j * bits, 8)
        value = groups[:, j] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].ravel()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return data[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    rows = -(-n // 8)
    groups = np.zeros((rows, bits + 8), np.uint8)
    flat = np.zeros(rows * bits, np.uint8)
    flat[: min(len(data), len(flat))] = data[: len(flat)]
    groups[:, :bits] = flat.reshape(rows, bits)
    out = np.zeros((rows, 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = np.zeros(rows, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= groups[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


def file_parts(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    blocks = [pack_bits(ids[at : at + BLOCK], bits) for at in range(0, len(ids), BLOCK)]
    return files.pack(
        np.array([bits, len(ids)], np.int64),
        np.array([d or 0 for d in doc_ids], np.int64),
        np.array([d is None for d in doc_ids], np.uint8),
        np.concatenate(([0], np.cumsum(lengths))).astype(np.int64),
        np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.int64),
        np.concatenate([np.zeros(0, np.uint8), *blocks]),
    )


class TokenFile:
    """A file's doc_ids (None where null), `starts` of their tokens, and any range of its tokens."""

    def __init__(self, path: str):
        head, ids, null, self.starts, self._at, self._data = files.unpack(files.mapped(path), np.int64, np.int64, np.uint8, np.int64, np.int64, np.uint8)
        self.bits, self.n_tokens = head.tolist()
        self.doc_ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist())]

    def tokens(self, start: int, end: int) -> np.ndarray:
        first, out = start // BLOCK, []
        for b in range(first, -(-end // BLOCK) if end > start else first):
            n = min(BLOCK, self.n_tokens - b * BLOCK)
            out.append(unpack_bits(self._data[self._at[b] : self._at[b + 1]], n, self.bits))
        return np.concatenate([np.zeros(0, np.uint32), *out])[start - first * BLOCK : end - first * BLOCK]


#: Pieces that are encoded as one text.
JOINED = 1000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tuple[Units, int]:
    """A tokenizers file's encoder and vocabulary size, one a worker; a text's ids are those of the library's own encode()."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = [a.content.encode() for a in t.get_added_tokens_decoder().values()]  # in a text they are tokens of their own
    spelled = t.get_vocab(with_added_tokens=True)
    n_bytes = np.zeros(max(spelled.values()) + 1, np.int64)
    n_bytes[list(spelled.values())] = list(map(len, spelled))  # byte-level BPE spells each byte by one letter

    def encode(free: list[str], others: list[str]) -> Table:
        # tokens of texts that stand side by side go back to them by their bytes
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [free[i : i + JOINED] for i in range(0, len(free), JOINED)]
        for group, e in zip(groups, t.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False) if groups else ()):
            ids.append(np.array(e.ids, np.uint32))
            ends = np.cumsum(list(map(len, map(str.encode, group))))
            sizes.append(np.diff(np.searchsorted(np.cumsum(n_bytes[ids[-1]]), ends, "left") + 1, prepend=0))
        for e in t.encode_batch_fast(others, add_special_tokens=False) if others else ():
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        return Table(np.concatenate(ids), np.concatenate(sizes))

    return Units(encode, added, lambda text: t.encode(text, add_special_tokens=False).ids), t.get_vocab_size(with_added_tokens=True)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as files under path; (file, first, n_docs, n_tokens) of each, `first` counting tokens before it.

    Ascending doc_id, null first, equal ids by a hash of the text. Null texts count as empty. end_id is appended to each
    document. Texts are taken whole; a repeated row is written as often. A file holds FILE_TOKENS or one slice of texts more.
    The tokenizer must cut texts as byte-level BPE does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        units, vocabulary = tokenizer(tokenizer_path)
        part, seq, bits = TaskContext.get().partitionId(), 0, width(vocabulary)
        doc_ids: list = []
        parts: list = []
        lengths: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = f"tokens-{part:08d}-{seq:08d}"
            files.put(f"{path}/{name}", file_parts(doc_ids, np.concatenate(lengths), np.concatenate(parts), bits))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64())], names=["file", "n_docs", "n_tokens"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in tx.slices(batch.column(1), SLICE):
                tokens, first = units.ids(data, offsets)
                if end_id is not None:
                    tokens, first = np.insert(tokens, first[1:], end_id), first + np.arange(len(first))
                doc_ids += ids[a:b]
                lengths.append(np.diff(first))
                parts.append(tokens.astype(np.uint16 if bits <= 16 else np.uint32))
                held += len(tokens)
                if held >= FILE_TOKENS:
                    yield flush()
                    doc_ids, parts, lengths, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))  # many rows of one id, or of none, go to several parts
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    listed = written(ordered.mapInArrow(run, "file string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return listed.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("first"), "n_docs", "n_tokens")


def read_token_files(listed: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(f"{path}/{name}")
                for at in range(0, len(file.doc_ids), 1000):
                    starts = file.starts[at : at + 1001]
                    ids = file.tokens(int(starts[0]), int(starts[-1])).astype("<u4")
                    edges = (starts - starts[0]).tolist()
                    crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[at : at + 1000], pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    dealt = listed.select("file", "first").repartition(shuffle_partitions(listed.sparkSession))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = None) -> DataFrame:
    """Writes docs to token files in the shared folder and reads them back: see read_token_files.

    Columns of docs beside doc_id and text are not looked at. An empty table makes no files and gives an empty one.
    """
    path = fresh_path(tx.in_small_batches(docs).sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, path, end_id), path)
