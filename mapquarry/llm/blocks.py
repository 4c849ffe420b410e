"""Small numpy helpers shared by the pair operators: runs of a sorted stream and link forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` of a stream that is sorted by it.

    Every table holds all rows of the keys it has; a run is held in memory until it ends.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = int(np.searchsorted(keys, keys[-1], "left"))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def starts(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of ``keys``: ``starts[i]:starts[i + 1]``."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``0..n-1`` over the links ``a-b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    return label
