"""Columns of numbers and words, packed into one binary value for a shuffle."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def tidy(make: Callable) -> Callable:
    """A batch function that gives memory back when it is done: Python workers wait
    for their next task with what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return

    return run


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32, one byte of all of them after the other, compressed."""
    return zlib.compress(np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.array([len(w) for w in words], np.int64)), zlib.compress(b"".join(words), 1)


def unpack_words(sizes: bytes, data: bytes) -> list[str]:
    ends = np.cumsum(unpack(sizes)).tolist()
    text = zlib.decompress(data)
    return [text[start:end].decode() for start, end in zip([0, *ends], ends, strict=False)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^63, as the steps between them."""
    steps = np.diff(values, prepend=0).astype("<i8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(steps)


def pack_floats(values: np.ndarray) -> bytes:
    """Numbers to seven digits."""
    return zlib.compress(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_floats(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<f4").ravel().astype(float)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Places of the members of each bucket that has some, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k] < cuts[k + 1]]
