"""Byte-level BPE through a sentencepiece model that is written from the ranks.

Each rank becomes a piece whose bytes are mapped to letters as byte-level BPE does, with minus the rank as its score:
sentencepiece then merges the pair of least rank first, leftmost among equals. The normalisation is the identity, the
unknown piece comes after the last rank. Pre-tokens are encoded alone; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from geoweave.llm.units import SLICE, Table, Units
from geoweave.llm import text as tx


def byte_letters() -> list[str]:
    """The letter for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE; ids are ranks, the unknown piece has the id len(ranks)."""
    letters = byte_letters()
    pieces = [_field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, token in enumerate(ranks)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks, split by pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = sorted(rank_of, key=rank_of.__getitem__)
        assert [rank_of[t] for t in self.tokens] == list(range(len(self.tokens))), "ranks have gaps"
        self._find = regex.compile(pattern).findall
        letters = byte_letters()
        self._letters = dict(enumerate(letters))
        self._parted = {b: x for b, x in self._letters.items() if b}  # leaves what parts tokens as it is
        self._rank_of = {"".join(map(letters.__getitem__, t)): r for t, r in rank_of.items()}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.tokens))
        self.bytes_of = Table.of_bytes(self.tokens)
        self.decimal_of = Table.of_bytes([b"%d " % i for i in range(len(self.tokens))])
        self.units = Units(self._encode)

    def _encode(self, free: list[str], others: list[str]) -> Table:
        split = list(map(self._find, chain(free, others)))
        tokens = list(chain.from_iterable(split))
        spelled = "\0".join(tokens).encode().decode("latin-1").translate(self._parted).split("\0")
        if len(spelled) != len(tokens) or not tokens:  # some hold byte 0 themselves
            spelled = [t.encode().decode("latin-1").translate(self._letters) for t in tokens]
        whole = np.array([self._rank_of.get(t, -1) for t in spelled], np.int64)
        new = np.flatnonzero(whole < 0)
        parts = [x for at in range(0, len(new), 10_000) for x in self._model.encode([spelled[i] for i in new[at : at + 10_000].tolist()], num_threads=1)]
        found = Table.of_lists(parts)
        sizes = np.ones(len(whole), np.int64)
        sizes[new] = np.diff(found.at)
        ids = np.zeros(int(sizes.sum()), np.uint32)
        at = np.cumsum(sizes) - sizes
        ids[at[whole >= 0]] = whole[whole >= 0]
        ids[tx.ranges(at[new], sizes[new])] = found.data
        edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(list(map(len, split)), dtype=np.int64))]
        return Table(ids, np.diff(edges))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets = tx.flat(pa.array(texts, pa.string()))
        ids, first = self.units.ids(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        return np.split(ids, first[1:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.gather(np.asarray(ids))[0].tobytes()


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    """One a worker."""
    return ByteBPE(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (text, and others) as (rest, token_ids, n_tokens, ids_sha256, decoded_sha256).

    rest: a struct of the other columns, whatever their names. ids_sha256 is of the decimal ids joined by one space,
    decoded_sha256 of the bytes that the ids decode to. Null texts count as empty: no ids. Texts are taken whole; a row
    that is repeated comes out as often. An empty table gives an empty one. path must be readable on every executor.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    docs = tx.in_small_batches(docs).select(F.col("text").cast("string").alias("text"), (F.struct(*others) if others else F.lit(0)).alias("rest"))
    kind = docs.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(0), SLICE):
                ids, first = bpe.units.ids(data, offsets)
                digests = []
                for table, cut in ((bpe.decimal_of, 1), (bpe.bytes_of, 0)):  # a space ends each number
                    joined, at = table.gather(ids)
                    edges = at[first].tolist()
                    digests.append(pa.array([sha256(joined[s : max(s, e - cut)]).hexdigest() for s, e in zip(edges[:-1], edges[1:])], pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), lists, pa.array(np.diff(first)), *digests], names=["rest", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"rest {kind}, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
