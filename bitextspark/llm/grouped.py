"""Groups of a sorted stream of Arrow batches, and labels of links found inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of rows with equal `keys` (numbers, sorted), with the bounds
    of the groups. Only the last group of a batch is held back until it is known to be whole."""

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        cuts = bounds(table)
        last = int(cuts[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), cuts[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of `n` positions reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
