"""Nearest nondecreasing curves by pooling with a stack, in Arrow batches: time linear in the number of levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

ship(__name__)

#: Curves that are pooled together.
ROWS = 4096


def pooled(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows made nondecreasing in the weighted norm; rising rows stay as they are.

    Every row has a stack of blocks. A level is pushed as a block of its own, and merged into the one below while that has
    the larger average; rows go side by side.
    """
    out, k = values.copy(), values.shape[1]
    w = np.ones(k) if weights is None else np.asarray(weights, float)
    bad = np.flatnonzero((np.diff(values, axis=1) < 0).any(1))
    for at in range(0, len(bad), ROWS):
        rows = bad[at : at + ROWS]
        v, each = values[rows], np.arange(len(rows))
        total, weight, begin = np.zeros((len(rows), k)), np.ones((len(rows), k)), np.zeros((len(rows), k), np.int64)
        top = np.full(len(rows), -1)
        for j in range(k):
            top += 1
            total[each, top], weight[each, top], begin[each, top] = v[:, j] * w[j], w[j], j
            live = each[top > 0]
            while len(live):
                t = top[live]
                fall = total[live, t - 1] * weight[live, t] > total[live, t] * weight[live, t - 1]
                live, t = live[fall], t[fall]
                total[live, t - 1] += total[live, t]
                weight[live, t - 1] += weight[live, t]
                top[live] -= 1
                live = live[top[live] > 0]
        height = np.zeros((len(rows), k), np.int64)  # each level's block: the starts counted up
        used = np.arange(k)[None, :] <= top[:, None]
        height[np.nonzero(used)[0], begin[used]] = 1
        block = np.cumsum(height, 1) - 1
        out[rows] = np.take_along_axis(total / weight, block, 1)
    return out


def projected(df: DataFrame, column: str, weights: list[float] | None = None) -> DataFrame:
    """df with the column's curves made nondecreasing; all have one length. For up to 64 levels curves.project_monotone stays in the JVM.

    Null curves stay null, an empty table stays empty; other columns and repeated rows stay as they are.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(at)
            flat = q.flatten().to_numpy(zero_copy_only=False).astype(float)
            n = len(q) - q.null_count
            made = iter(pooled(flat.reshape(n, -1), weights).tolist() if n else [])
            yield b.set_column(at, column, pa.array([next(made) if ok else None for ok in q.is_valid().to_pylist()], q.type))

    return df.mapInArrow(run, df.schema)
