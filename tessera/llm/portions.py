"""Bounded work per step inside a batch of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about so many bytes, one row at least, so that only that much is ever held
    as Python objects. In the end the memory that is kept for later is given back: a worker lives on."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return free memory to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_length(words: Iterable[str], letters: int) -> Iterator[list[str]]:
    """Words of one length together, in groups of about so many letters."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for size, group in groups.items():
        most = max(1, letters // max(1, size))
        for i in range(0, len(group), most):
            yield group[i : i + most]
