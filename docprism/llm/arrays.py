"""Sorted hash arrays in files that every worker maps into memory.

A table is a set of 64-bit keys with columns of counts, cut into shards by the top
bits of the keys.  A shard's keys are sorted and kept as the 32 bits that follow the
shard's and the bucket's bits; ``INDEX`` bits after the shard's say in which bucket a
key lies.  Counts take one byte; larger ones stand in a list beside it.  Files come
into being under another name and are renamed, so a task that runs again does no harm.

Shards are as small as a task that counts must hold them, so their number grows with
the corpus, and a batch of keys meets all of them.  :func:`join_shards` puts up to
``2^JOINED`` neighbours into one, where that leaves no fewer than ``2^FEW``.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from docprism.llm.store import _own_folder

U64 = np.uint64
INDEX = 16
#: Binary digits of the number of shards below which none are joined, and of how many are joined at most.
FEW, JOINED = 6, 10
#: Arrays that a worker keeps open.
OPEN = 8192


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which must be mounted on every machine, as workers map its files."""
    folder = _own_folder(spark)
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    elif not folder.startswith("/"):
        raise RuntimeError("models are memory-mapped: spark.checkpoint.dir must be a file: folder that is mounted on all machines")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _save(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, array)
    os.replace(part, path)


@functools.lru_cache(maxsize=OPEN)
def _load(path: str) -> np.ndarray | None:
    return np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else None  # a plain view: numpy's class of mapped arrays costs more than short reads


def write_shard(folder: str, table: str, shard: int, bits: int, keys: np.ndarray, columns: dict[str, np.ndarray], wide: dict[str, np.ndarray] | None = None) -> None:
    """Sorted ``keys`` whose top ``bits`` are ``shard``, with their columns; ``wide`` ones are stored as they are."""
    at = f"{folder}/{table}.{shard}"
    bucket = ((keys << U64(bits)) >> U64(64 - INDEX)).astype(np.int64)
    _save(f"{at}.rest.npy", ((keys << U64(bits + INDEX)) >> U64(32)).astype(np.uint32))
    for name, values in (wide or {}).items():
        _save(f"{at}.{name}.npy", values)
    for name, values in columns.items():
        large = np.flatnonzero(values >= 255)
        _save(f"{at}.{name}.large.npy", np.stack([large, values[large].astype(np.int64)]))
        _save(f"{at}.{name}.npy", np.minimum(values, 255).astype(np.uint8))
    _save(f"{at}.index.npy", np.searchsorted(bucket, np.arange((1 << INDEX) + 1)).astype(np.uint32 if len(keys) < 1 << 32 else np.int64))


def join_shards(spark: SparkSession, folder: str, bits: int, tables: dict[str, tuple[str, ...]]) -> int:
    """Joins the shards of each table (with its columns of counts), and gives the binary digits of how many are one; a task a joined shard, which holds a shard's column at a time."""
    more, names = min(max(bits - FEW, 0), JOINED), list(tables)
    if not more:
        return 0
    groups = 1 << (bits - more)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                _join(folder, names[i // groups], i % groups, more, tables[names[i // groups]])
            yield batch

    spark.range(0, len(names) * groups, 1, len(names) * groups).mapInArrow(run, "id long").count()
    return more


def _join(folder: str, table: str, group: int, more: int, columns: tuple[str, ...]) -> None:
    parts = [f"{folder}/{table}.{s}" for s in range(group << more, (group + 1) << more)]
    out = f"{folder}/{table}.joined.{group}"
    if not os.path.exists(f"{out}.index.npy"):  # it comes last; else this task ran before
        read = lambda at, name: np.load(f"{at}.{name}.npy", mmap_mode="r")
        there = [os.path.exists(f"{at}.index.npy") for at in parts]
        sizes = np.array([len(read(at, "rest")) if held else 0 for at, held in zip(parts, there)], np.int64)
        if not sizes.sum():
            return
        base = np.cumsum(sizes) - sizes
        kept = [(at, b) for at, held, b in zip(parts, there, base) if held]
        kind = np.uint32 if sizes.sum() < 1 << 32 else np.int64
        for name, of in (("rest", np.uint32), *((c, np.uint8) for c in columns)):
            _save_parts(f"{out}.{name}.npy", int(sizes.sum()), of, (read(at, name) for at, _ in kept))
        for c in columns:
            _save(f"{out}.{c}.large.npy", np.concatenate([read(at, f"{c}.large") + np.array([[b], [0]]) for at, b in kept], axis=1))
        index = ((read(at, "index")[:-1] + b if held else np.full(1 << INDEX, b)).astype(kind) for at, held, b in zip(parts, there, base))
        _save_parts(f"{out}.index.npy", (len(parts) << INDEX) + 1, kind, itertools.chain(index, [sizes.sum(keepdims=True).astype(kind)]))
    for at in parts:
        for name in ("rest", *columns, *(f"{c}.large" for c in columns), "index"):
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{at}.{name}.npy")


def _save_parts(path: str, size: int, kind, parts) -> None:
    """As :func:`_save`, an array of ``size`` numbers that comes in parts."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.lib.format.write_array_header_1_0(file, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": (size,)})
        for x in parts:
            file.write(np.ascontiguousarray(x).data)
    os.replace(part, path)


def sorted_places(keys: np.ndarray, exact: bool = True) -> np.ndarray:
    """Stable order of unsigned keys; not ``exact``: of the leading bits that fit beside a place.

    Numbers of 64 bits that hold a key's leading bits and its place are sorted as
    values, several times as fast as places by keys; what they leave out of order is
    almost sorted.
    """
    if not len(keys):
        return np.zeros(0, np.int64)
    digits = max((len(keys) - 1).bit_length(), 1)
    lost = max(int(keys.max()).bit_length() + digits - 64, 0)
    joint = keys.astype(U64) >> U64(lost) << U64(digits) | np.arange(len(keys), dtype=U64)
    joint.sort()
    order = (joint & U64((1 << digits) - 1)).astype(np.int64)
    if exact and lost:
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            order = order[np.argsort(found, kind="stable")]
    return order


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and which of them each is."""
    order = sorted_places(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


def look_up(folder: str, table: str, bits: int, keys: np.ndarray, columns: tuple[str, ...], more: int = 0) -> list[np.ndarray]:
    """Shard-wise place of each key (-1: not there), then its columns (0: not there); ``more``: what :func:`join_shards` gave.

    Equal keys are looked up each; where there are many, the caller asks for different ones.
    """
    order = sorted_places(keys, exact=False)  # a shard's keys must adjoin, and near ones should
    keys = keys[order]
    place = np.full(len(keys), -1, np.int64)
    values = [np.zeros(len(keys), np.int64) for _ in columns]
    top, name = bits - more, f"{table}.joined" if more else table
    shard = (keys >> U64(64 - top)).astype(np.int64) if top else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
        at = f"{folder}/{name}.{shard[a]}"
        index = _load(f"{at}.index.npy")
        if index is None:  # no key has these top bits
            continue
        held, q = _load(f"{at}.rest.npy"), keys[a:b]
        bucket = ((q << U64(top)) >> U64(64 - INDEX - more)).astype(np.int64)
        rest = ((q << U64(bits + INDEX)) >> U64(32)).astype(np.uint32)
        lo, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
        most = int((end - lo).max()).bit_length()
        lo -= 1
        for digit in range(most - 1, -1, -1):  # as far as smaller ones go, by falling powers of two
            ahead = lo + (1 << digit)
            less = held.take(ahead, mode="clip") < rest
            less &= ahead < end
            np.copyto(lo, ahead, where=less)
        lo += 1
        found = np.flatnonzero((lo < end) & (held.take(lo, mode="clip") == rest))
        lo = lo[found]
        place[a + found] = lo
        for column, out in zip(columns, values):
            small = _load(f"{at}.{column}.npy")[lo]
            big = np.flatnonzero(small == 255) if small.dtype == np.uint8 else ()
            small = small.astype(np.int64)
            if len(big):
                where, count = _load(f"{at}.{column}.large.npy")
                small[big] = count[np.searchsorted(where, lo[big])]
            out[a + found] = small
    out = [np.empty_like(x) for x in (place, *values)]
    for x, y in zip(out, (place, *values)):
        x[order] = y
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length as compressed bytes; the first is sorted and stored by differences, all by byte planes."""
    out = [np.array([len(arrays[0]), len(arrays)], "<i8").tobytes()]
    for k, a in enumerate(arrays):
        if k == 0 and len(a):
            a = np.append(a[:1], a[1:] - a[:-1])
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        data = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
        out += [np.array([a.itemsize, len(data)], "<i8").tobytes(), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(data, "<i8", 2)
    at, out = 16, []
    for i in range(k):
        width, size = np.frombuffer(data, "<i8", 2, at)
        planes = np.frombuffer(pa.decompress(data[at + 16 : at + 16 + size], n * width, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        a = np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(f"<u{width}")
        out.append(np.cumsum(a, dtype=a.dtype) if i == 0 else a)
        at += 16 + size
    return out
