"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

A table of 64-bit keys with counts is built in two steps. Each map task counts what it sees, packs
the sorted keys of every shard into one compressed blob (differences of sorted keys, byte planes)
and emits it; the task that gets all blobs of a shard adds them up and writes one file. So a
frequent key is one entry per task, shards are even because keys are hashed, and a lost task is
run again and writes the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tessera.llm.common import get_file, put_file

#: Entries that a map task holds before it packs them.
HELD = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A column of counts of four or, where one needs it, eight bytes, behind columns of eight.
COUNT = "count"


def shard_of(keys: np.ndarray, bits: int, mixed: bool) -> np.ndarray:
    """Top bits of the key, or of its product with an odd constant where keys aren't hashes."""
    k = keys * MIX if mixed else keys
    return (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def by_shard(shard: np.ndarray) -> np.ndarray:
    """The order by shard that keeps that of the keys; numpy sorts 16 bits by radix."""
    narrow = not len(shard) or int(shard.max()) < 1 << 16
    return np.argsort(shard.astype(np.uint16) if narrow else shard, kind="stable")


def planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def width_of(c: np.ndarray) -> str:
    """Four bytes for counts that fit them, else eight."""
    return "<u4" if not len(c) or int(c.max()) < 1 << 32 else "<u8"


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys and counts as bytes."""
    kinds = [width_of(c) for c in columns]
    parts = [np.diff(keys, prepend=np.uint64(0)), *(c.astype(k) for c, k in zip(columns, kinds, strict=True))]
    head = len(keys).to_bytes(8, "little") + bytes(int(k[2:]) for k in kinds)
    return head + zlib.compress(b"".join(map(planes, parts)), 1)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = zlib.decompress(blob[8 + n_columns :])
    out, at = [np.cumsum(unplanes(raw, n, "<u8"), dtype=np.uint64)], 8 * n
    for width in blob[8 : 8 + n_columns]:
        out.append(unplanes(raw[at:], n, f"<u{width}").astype(np.int64))
        at += width * n
    return out


def add_up(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, with the sums of their columns."""
    if not len(keys):
        return [keys, *columns]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in columns)]


class Counts:
    """Counts of keys within one map task; ``blobs`` empties it."""

    def __init__(self, bits: int, mixed: bool) -> None:
        self.bits, self.mixed = bits, mixed
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n)
        self.held += len(k)
        if self.held > HELD and len(self.keys) > 1:
            k, n = add_up(np.concatenate(self.keys), np.concatenate(self.n))
            self.keys, self.n, self.held = [k], [n], len(k)

    @property
    def full(self) -> bool:
        return self.held > HELD

    def blobs(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            k, n = add_up(np.concatenate(self.keys), np.concatenate(self.n))
            self.keys, self.n, self.held = [], [], 0
            yield from blobs_of(shard_of(k, self.bits, self.mixed), k, n)


def blobs_of(shard: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (``shard``, ``blob``) per shard; keys are sorted."""
    order = by_shard(shard)
    shard, keys, columns = shard[order], keys[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else []
    for i in range(0, len(edges) - 1, 64):
        part = [(int(shard[a]), pack(keys[a:z], *(c[a:z] for c in columns))) for a, z in zip(edges[i : i + 64], edges[i + 1 : i + 65], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int64()), pa.array([b for _, b in part], pa.binary())], ["shard", "blob"])


def gathered(batches: Iterable[pa.RecordBatch], n_columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, sums) of all shards among the blobs of one partition."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blobs.setdefault(s, []).append(b)
    for s in sorted(blobs):
        parts = [unpack(b, n_columns) for b in blobs.pop(s)]
        yield s, add_up(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """One file: the arrays, each begun at a multiple of 8 bytes."""
    out = bytearray()
    for a in arrays:
        out += a.tobytes()
        out += bytes(-len(out) % 8)
    put_file(uri, out)


def map_arrays(uri: str, n: int, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of ``write_arrays`` (each of n entries), memory-mapped."""
    if not n:
        return [np.empty(0, k) for k in kinds]
    raw = np.asarray(np.memmap(get_file(uri), np.uint8, "r"))
    out, at = [], 0
    # The last column may be of COUNT: as wide as the file is long.
    kinds = [("<u8" if len(raw) >= 8 * n * len(kinds) else "<u4") if k == COUNT else k for k in kinds]
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(raw[at : at + size].view(k))
        at += size + -size % 8
    return out


@dataclass
class Shards:
    """A table in shard files. ``sizes[s]`` is the number of keys of shard s."""

    folder: str
    bits: int
    mixed: bool
    sizes: list[int]
    kinds: list[str]

    def open(self) -> Opened:
        return Opened(self)


class Opened:
    """Shards as one worker sees them; files are mapped when first needed."""

    def __init__(self, table: Shards) -> None:
        self.table = table
        self.offsets = np.concatenate([[0], np.cumsum(table.sizes)]).astype(np.int64)
        self.maps: dict[int, list[np.ndarray]] = {}

    def arrays(self, s: int) -> list[np.ndarray]:
        if s not in self.maps:
            self.maps[s] = map_arrays(f"{self.table.folder}/{s:06d}", self.table.sizes[s], ["<u8", *self.table.kinds])
        return self.maps[s]

    def find(self, keys: np.ndarray, *defaults: float) -> tuple[np.ndarray, ...]:
        """For distinct sorted keys: the place of each among all keys (-1: absent), and its values."""
        t = self.table
        shard = shard_of(keys, t.bits, t.mixed)
        order = by_shard(shard)
        ordered = keys[order]
        place = np.full(len(keys), -1, np.int64)
        values = [np.full(len(keys), d, "<u8" if k == COUNT else k) for d, k in zip(defaults, t.kinds, strict=False)]
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist() if len(keys) else []
        for a, z in pairwise(edges):
            s = int(shard[order[a]])
            if not t.sizes[s]:
                continue
            own, *columns = self.arrays(s)
            sought = ordered[a:z]
            at = np.searchsorted(own, sought)
            there = np.minimum(at, len(own) - 1)
            hit = own[there] == sought
            np.copyto(place[a:z], at + self.offsets[s], where=hit)
            for v, c in zip(values, columns, strict=False):
                np.copyto(v[a:z], c[there], where=hit)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return place[back], *(v[back] for v in values)
