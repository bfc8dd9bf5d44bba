"""Files that tasks write and map in the shared folder. A file appears under its name only when it is whole."""

from __future__ import annotations

import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def put(path: str, parts: list[bytes]) -> None:
    """Writes path (a URI); a task that runs twice leaves the same file."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, at)


@lru_cache(maxsize=4096)
def mapped(path: str) -> np.ndarray:
    """The bytes of path: memory-mapped if the shared folder is mounted, else read once a worker."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return np.memmap(unquote(url.path), np.uint8, "r")
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint8)


def pack(*arrays: np.ndarray) -> list[bytes]:
    """A header of lengths in bytes, then the arrays, each at a multiple of 8."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return [head, *(r + bytes(-len(r) % 8) for r in raw)]


def unpack(data: np.ndarray, *types: type) -> list[np.ndarray]:
    n = int(data[:8].view(np.int64)[0])
    assert n == len(types), f"{n} arrays, not {len(types)}"
    sizes = data[8 : 8 + 8 * n].view(np.int64)
    out, at = [], 8 + 8 * n
    for size, kind in zip(sizes.tolist(), types):
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out
