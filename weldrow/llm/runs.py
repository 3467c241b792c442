"""Arrow helpers: consecutive equal keys as runs, across batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as NumPy; equally long lists as rows of a matrix."""
    x = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
        flat = x.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 0)
    return x.to_numpy(zero_copy_only=False)


def iter_runs(batches: Iterator[pa.RecordBatch], keys: list[str], lists: tuple[str, ...] = ()) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal ``keys`` in a partition sorted by them. Columns in ``lists`` come as lists of arrays."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {n: np.concatenate([h[n] for h in held]) for n in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {}
        for n in batch.schema.names:
            if n in lists:
                x = batch.column(batch.schema.get_field_index(n))
                out = np.empty(len(x), dtype=object)
                flat, off = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
                for i in range(len(x)):
                    out[i] = flat[off[i] : off[i + 1]]
                cols[n] = out
            else:
                cols[n] = column(batch, n)
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        if held and any(held[-1][k][-1] != cols[k][0] for k in keys):
            yield joined()
            held = []
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = {n: x[s:e] for n, x in cols.items()}
            if e < batch.num_rows:
                if held:
                    held.append(part)
                    yield joined()
                    held = []
                else:
                    yield part
            else:
                held.append(part)
    if held:
        yield joined()


class Sets:
    """Disjoint sets over 0..n-1; the smallest member stands for its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
