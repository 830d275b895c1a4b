"""Bins of a batch of rows, dense or sparse: what routing and histograms read. Bin 0, missing, is not stored when sparse."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Dense:
    """Rows by columns."""

    def __init__(self, bins: np.ndarray):
        self.bins = np.asfortranarray(bins)  # a column lies together

    def __len__(self) -> int:
        return len(self.bins)

    def pick(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The bin of each pair of row and column."""
        return self.bins[rows, cols]

    def columns(self) -> None:
        """Columns that have a bin other than 0; None: any may."""
        return None

    def sums(self, col: int, rows: np.ndarray, at: np.ndarray, nodes: int, size: int, weights: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
        """(weights, nodes, bins): sums of the weights of ``rows``, which are in the nodes ``at``, by bin of a column."""
        cell = at * size + self.bins[:, col][rows]
        return np.stack([np.bincount(cell, weights=w, minlength=nodes * size) for w in weights]).reshape(len(weights), nodes, size)


class Sparse:
    """Filled cells by row, each row's columns ascending. Histograms add up filled cells alone; the missing bin is the rest."""

    def __init__(self, first: np.ndarray, cols: np.ndarray, bins: np.ndarray):
        self.first, self.col, self.bin = first, cols.astype(np.int64), bins.astype(np.int64)
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.width = int(self.col.max()) + 1 if len(cols) else 1
        self.keys = self.row * self.width + self.col
        order = np.argsort(self.col, kind="stable")
        self.by_col, self.known = order, np.unique(self.col)
        self.start = np.searchsorted(self.col[order], np.append(self.known, self.width))

    def __len__(self) -> int:
        return len(self.first) - 1

    def pick(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(rows), np.int64)
        key = rows * self.width + cols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((cols < self.width) & (self.keys[at] == key), self.bin[at], 0)

    def columns(self) -> np.ndarray:
        return self.known

    def sums(self, col: int, rows: np.ndarray, at: np.ndarray, nodes: int, size: int, weights: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
        k = int(np.searchsorted(self.known, col))
        mine = self.by_col[self.start[k] : self.start[k + 1]] if k < len(self.known) and self.known[k] == col else np.zeros(0, np.int64)
        place = np.full(len(self), -1)
        place[rows] = np.arange(len(rows))
        inside = place[self.row[mine]]
        mine, inside = mine[inside >= 0], inside[inside >= 0]
        cell = at[inside] * size + self.bin[mine]
        out = np.stack([np.bincount(cell, weights=w[inside], minlength=nodes * size) for w in weights]).reshape(len(weights), nodes, size)
        out = out.astype(float)  # counts of nothing are integers
        out[:, :, 0] = totals - out.sum(axis=2)
        return out


def column_matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as rows by places."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def cells_of(rows: pa.RecordBatch) -> Dense | Sparse:
    """The cells of a batch with ``bins``, and ``cols`` if it is sparse."""
    if "cols" not in rows.schema.names:
        return Dense(column_matrix(rows.column("bins")).astype(np.int64))
    cols, bins = rows.column("cols"), rows.column("bins")
    first = np.append(0, np.cumsum(cols.value_lengths().to_numpy(zero_copy_only=False)))
    return Sparse(first, cols.flatten().to_numpy(zero_copy_only=False), bins.flatten().to_numpy(zero_copy_only=False))
