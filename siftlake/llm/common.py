"""Shared plumbing: resident models, caches, size-checked payloads, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Set
from typing import Generic, TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import BROADCAST_ROWS, bounded, materialize, on_workers, settled, shared_dir, shuffled, slim, sweep

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "CACHE_BYTES", "Cache", "bounded", "fresh", "materialize", "on_workers", "read_bytes", "release", "resident", "settled", "shared_dir", "ship", "shuffled", "slim", "sweep", "table", "text_slices", "trim", "unload", "with_text"]

#: Largest payload that is ever put into a broadcast, in bytes.
BROADCAST_BYTES = 64 << 20
#: Text bytes handled at once inside a Python worker.
SLICE_BYTES = 4 << 20

#: Bytes that a worker's cache of chunks takes at most, about.
CACHE_BYTES = 64 << 20
#: Chunks that are learned at once, and bytes that a cached one takes besides its own.
_LEARN = 1 << 14
_ENTRY_BYTES = 160

T = TypeVar("T")

_resident: dict[object, object] = {}


def resident(key: object, build: Callable[[], T]) -> T:
    """What ``build`` makes, kept in this worker for as long as the same thing is asked for.

    Workers outlive tasks and queries; only one model stays in memory at a time.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def release() -> None:
    """Free what ``resident`` holds in this worker; called by whatever runs there without a model of its own."""
    if _resident:
        _resident.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't give memory back
        ctypes.CDLL(None).malloc_trim(0)


def unload(shipped) -> None:
    """Forget this process's copy of a broadcast's value; it is read again where it is asked for again."""
    shipped.__dict__.pop("_value", None)


class Cache(Generic[T]):
    """Results by text chunk, bounded to about ``n_bytes``: what hasn't been used since the last turnover goes at the next.

    Chunks longer than ``LONG`` are learned each time they are met.
    """

    LONG = 256

    def __init__(self, n_bytes: int):
        self._half = n_bytes // 2
        self._young: dict[bytes, T] = {}
        self._old: dict[bytes, T] = {}
        self._size = 0
        self._passing: list[bytes] = []

    def clear(self) -> None:
        """Forget everything, and give the memory back; for the end of a task, after which a worker may lie idle."""
        self._young, self._old, self._size, self._passing = {}, {}, 0, []
        trim()

    def serve(self, wanted: Set[bytes], learn: Callable[[list[bytes]], dict[bytes, T]]) -> dict[bytes, T]:
        """A dictionary that holds all of ``wanted`` until the next call; ``learn`` is asked for what isn't known."""
        for k in self._passing:
            del self._young[k]
        if self._size > self._half:
            self._old, self._young, self._size = self._young, {}, 0
        young, old = self._young, self._old
        new = wanted.difference(young)
        known = new.intersection(old)
        young.update((k, old[k]) for k in known)
        rest = list(new.difference(known))
        for i in range(0, len(rest), _LEARN):
            young.update(learn(rest[i : i + _LEARN]))
        self._passing = [k for k in rest if len(k) > self.LONG]
        self._size += sum(sys.getsizeof(k) + _ENTRY_BYTES for k in new if len(k) <= self.LONG)
        return young


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession, payload: object, n_bytes: int):
    """Broadcast ``payload`` after checking its stated size."""
    if n_bytes > BROADCAST_BYTES:
        raise ValueError(f"{n_bytes} bytes exceed the broadcast bound of {BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(payload)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def text_slices(column: pa.Array, n_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Consecutive ranges of a column of strings with about ``n_bytes`` of UTF-8 each (a longer text is a range of its own), and their texts."""
    binary = column.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(binary), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > n_bytes:
            yield start, i, binary.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes), binary.slice(start).to_pylist()


def with_text(keep: tuple[str, ...], text_column: str) -> tuple[list[str], int]:
    """The columns to hand to Python, each once, and where the text is among them."""
    columns = list(keep) if text_column in keep else [*keep, text_column]
    return columns, columns.index(text_column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
