"""Feature-parallel growth: bins lie by column, and what is gathered at a level is the rows' state, not their histograms.

The binned rows are written once as blocks: of each block a base row (keys, labels, weights, raw scores) and, for each group
of columns, their bins. A level is two queries. The first routes: base rows meet the columns that trees split on, and no
others, and give each block's sampled rows, nodes and gradients. The second adds up: these states, which are broadcast if
their counted size allows and else meet the columns by block, give whole histograms of each column where its bins lie; what
several tasks have of one column is added up at the end. Trees are those of data-parallel growth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.operators.cells import Dense, cells_of, column_matrix
from arborlane.session import broadcast_if_small, materialise, release

BLOCK_ROWS, GROUP_COLUMNS = 8192, 8
BLOCKS = "kind int, block long, part int, first int, bins binary, key binary, label binary, weight binary, raw binary"
STATE = "block long, state binary"
#: Bytes of states that may be sent to every task.
STATE_BYTES = 32 << 20


class Chosen(Dense):
    """Cells of some columns only, found by their numbers."""

    def __init__(self, bins: np.ndarray, columns: np.ndarray):
        super().__init__(bins)
        self.place = np.zeros(int(columns.max()) + 1 if len(columns) else 1, np.int64)
        self.place[columns] = np.arange(len(columns))

    def pick(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return self.bins[rows, self.place[cols]] if self.bins.shape[1] else np.zeros(len(rows), np.int64)


def _blocks(block_rows: int, width: int):
    """Base rows (kind 0) and rows of ``width`` columns (kind 1) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                rows = whole.slice(at, block_rows)
                bins = cells_of(rows).bins.astype(np.int32)
                block = part << 32 | number
                number += 1

                def row(kind: int, first: int, **given: np.ndarray) -> pa.RecordBatch:
                    binaries = {c: pa.array([np.ascontiguousarray(given[c]).tobytes()] if c in given else [None], pa.binary()) for c in ("bins", "key", "label", "weight", "raw")}
                    return pa.RecordBatch.from_arrays(
                        [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([first], pa.int32()), *binaries.values()],  # noqa: B023
                        names=["kind", "block", "part", "first", *binaries],
                    )

                numbers = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "weight")}
                yield row(0, 0, **numbers, raw=column_matrix(rows.column("raw")))
                for first in range(0, bins.shape[1], width):
                    yield row(1, first, bins=bins[:, first : first + width].T)

    return run


class Vertical:
    def __init__(self, booster):
        self.booster, self.since, self.width = booster, booster.since, GROUP_COLUMNS
        self.table = materialise(booster.data.mapInArrow(_blocks(BLOCK_ROWS, GROUP_COLUMNS), BLOCKS), "vertical", by="kind")
        booster.written.append(self.table)
        self.base, self.columns = (self.table.filter(F.col("kind") == k).drop("kind") for k in (0, 1))

    def states(self, round_) -> DataFrame:
        """(block, state): of each new tree the sampled rows, their nodes and gradients."""
        from arborlane.plans.boosting import Rows

        every = sorted({n.split.col for t in [*round_.trees, *round_.new] for n in t.nodes.values() if n.split})
        width = self.width
        groups = sorted({c // width * width for c in every})
        met = self.base.unionByName(self.columns.filter(F.col("first").isin(groups))) if groups else self.base
        outputs = len(round_.raw_base)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bases: dict[int, dict] = {}
            bins: dict[int, dict[int, np.ndarray]] = {}
            for b in batches:
                for r in b.to_pylist():
                    if r["bins"] is None:
                        bases[r["block"]] = r
                    else:
                        bins.setdefault(r["block"], {})[r["first"]] = np.frombuffer(r["bins"], np.int32)
            for block, r in bases.items():
                key, label, weight = np.frombuffer(r["key"], np.int64), np.frombuffer(r["label"], float), np.frombuffer(r["weight"], float)
                found = [bins[block][c // width * width].reshape(-1, len(key))[c % width] for c in every]
                cells = Chosen(np.stack(found, axis=1).astype(np.int64) if found else np.zeros((len(key), 0), np.int64), np.array(every, np.int64))
                raw = np.frombuffer(r["raw"], float).reshape(-1, outputs).copy()
                for t in range(round_.since, len(round_.trees)):
                    if round_.weights[t]:
                        raw[:, t % outputs] += round_.weights[t] * round_.trees[t].predict(cells)
                rows = round_.with_gradients(Rows(cells, weight, round_.objective.encode(label), raw, key))
                for i in range(len(round_.new)):
                    at, node, g, h = round_.placed(i, rows, r["part"])
                    state = np.concatenate([[i, len(key), len(at)], at, node, g, h])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([state.astype(float).tobytes()], pa.binary())], names=["block", "state"])

        return met.repartition(self.booster.tasks, "block").mapInArrow(run, STATE)

    def histograms(self, round_, active: set) -> DataFrame:
        """Packed histograms of the active nodes, of which several tasks may have parts."""
        from arborlane.plans.boosting import HIST, hist_batches

        states = materialise(self.states(round_), "states")
        size, columns = round_.params.max_bins, [set(c) for c in round_.columns]
        total = states.agg(F.coalesce(F.sum(F.length("state")), F.lit(0))).first()[0]
        few = broadcast_if_small(states, total, STATE_BYTES)
        self.booster.written.append(states)
        if getattr(self, "old", None) is not None:
            release(self.old)
        self.old = states

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[int, int, int], np.ndarray] = {}
            for b in batches:
                for r in b.to_pylist():
                    state = np.frombuffer(r["state"], float)
                    i, n, k = state[:3].astype(np.int64)
                    at, node, g, h = (state[3 + j * k : 3 + (j + 1) * k] for j in range(4))
                    at, node = at.astype(np.int64), node.astype(np.int64)
                    ok = np.isin(node, [m for t, m in active if t == i])
                    at, node, g, h = at[ok], node[ok], g[ok], h[ok]
                    if not len(at):
                        continue
                    nodes, inside = np.unique(node, return_inverse=True)
                    cells = Dense(np.frombuffer(r["bins"], np.int32).reshape(-1, n).T.astype(np.int64))
                    totals = np.stack([np.bincount(inside, weights=w) for w in (g, h)])
                    for c in range(cells.bins.shape[1]):
                        if r["first"] + c not in columns[i]:
                            continue
                        both = cells.sums(c, at, inside, len(nodes), size, [g, h], totals)
                        for j, m in enumerate(nodes.tolist()):
                            name = (int(i), m, r["first"] + c)
                            out[name] = out[name] + both[:, j] if name in out else both[:, j].copy()
            yield from hist_batches(out)

        return self.columns.select("block", "first", "bins").join(few, "block").mapInArrow(run, HIST)
