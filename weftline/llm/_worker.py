"""Helpers that run on the executors."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow.compute as pc


def slices(batch, column: int, most_bytes: int = 1 << 20):
    """An Arrow batch in parts of about ``most_bytes`` of one column's text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def worker_memory() -> dict:
    """What a Python worker may keep from task to task; nothing but caches belongs here."""
    return sys.modules.setdefault("_weftline_worker", types.ModuleType("_weftline_worker")).__dict__
