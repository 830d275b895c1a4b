"""The boosting driver. The driver owns the trees; each level is one query over the binned table.

A level's query computes, in each Arrow batch, raw scores from the model so far, gradients and node places, adds them to
the partition's histograms with ``np.bincount``, and deals the packed histograms by (tree, node, column). The tasks that
get them add them up and search splits; the driver collects the best split of each node, at most 2 ** depth rows a tree.
Where the table has many partitions, histograms are first added up in groups of partitions, ``aggregation_depth - 1`` times.
No rows are joined back by key and no lineage grows: the binned table is written once, and its raw-score columns anew
every ``checkpoint_interval`` rounds.

A binned table of at most ``LOCAL_BYTES`` comes to the driver, which runs the same functions over its partitions without a
query for each level. With ``parallelism_type`` feature, ``vertical.py`` deals the bins by column instead of the histograms.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.functions.metrics import Metric, measured, partials, totalled
from arborlane.functions.objectives import Objective, Square
from arborlane.operators.binning import WIDE, Discretizer, matrix
from arborlane.operators.cells import Dense, Sparse, cells_of, column_matrix
from arborlane.operators.sampling import choose_columns, hashed, keep_array, kth_least, share, tallied
from arborlane.operators.splits import Split, best_split, leaf_weight
from arborlane.operators.trees import Tree
from arborlane.params import Params
from arborlane.session import materialise, release, tasks_for

#: Histograms of a level that the driver may gather instead of dealing them to tasks.
DRIVER_BYTES = 8 << 20
#: A binned table that the driver may hold.
LOCAL_BYTES = 64 << 20


def mixed_seed(*parts: int) -> int:
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return x


@dataclass
class Rows:
    """A batch of binned rows: label and raw are rows by outputs, g and h of the whole round's raw score."""

    cells: Dense | Sparse
    weight: np.ndarray
    label: np.ndarray
    raw: np.ndarray
    key: np.ndarray
    g: np.ndarray | None = None
    h: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.weight)


@dataclass
class Round:
    """What a task must know to work out a level of one round."""

    objective: Objective
    raw_base: list[float]
    trees: list[Tree]
    weights: list[float]  # of trees, as the working score sees them
    since: int  # trees before this one are in the raw column
    new: list[Tree] = field(default_factory=list)
    columns: list[list[int]] = field(default_factory=list)  # of each new tree
    params: Params = None
    seed: int = 0
    goss: list[float] | None = None  # least norm of the top rows
    depth: int = 0
    units: list[int] | None = None  # of each base model the greatest hash of the sampled units, -1 where there is none

    def rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = cells_of(b)
            raw = column_matrix(b.column("raw")).astype(float).copy()
            for t in range(self.since, len(self.trees)):
                if self.weights[t]:
                    raw[:, t % raw.shape[1]] += self.weights[t] * self.trees[t].predict(cells)
            label = self.objective.encode(b.column("label").to_numpy(zero_copy_only=False).astype(float))
            yield self.with_gradients(Rows(cells, b.column("weight").to_numpy(zero_copy_only=False).astype(float), label, raw, b.column("key").to_numpy(zero_copy_only=False)))

    def with_gradients(self, rows: Rows) -> Rows:
        rows.g, rows.h = self.gradients(rows.weight, rows.label, rows.raw)
        return rows

    def gradients(self, weight, label, raw) -> tuple[np.ndarray, np.ndarray]:
        g, h = self.objective.compute(label, self.objective.transform(raw))
        return g * weight[:, None], h * weight[:, None]

    def sampled(self, key: np.ndarray, part: int, tree: int) -> np.ndarray:
        """Row mask of a base model, the same for its outputs."""
        p = self.params
        if p.sub_sample_rate_by_tree >= 1 or p.sub_sample_type == "goss":
            return np.ones(len(key), bool)
        unit = unit_of(p, key, part)
        base = tree // self.objective.size
        return hashed(unit_seed(self.seed, base), unit) <= np.uint64(self.units[base]) if self.units[base] >= 0 else np.zeros(len(key), bool)

    def goss_scale(self, g: np.ndarray, key: np.ndarray, tree: int) -> np.ndarray:
        """1 for rows of the top norms, the scale of the others' sample, 0 for the rest."""
        p = self.params
        norm = (g * g).sum(axis=1)
        top = norm >= self.goss[0]
        rest = keep_array(min(1.0, p.other_rate / (1 - p.top_rate)), mixed_seed(self.seed, 2, tree // self.objective.size), key)
        return np.where(top, 1.0, np.where(rest, (1 - p.top_rate) / p.other_rate, 0.0))

    def placed(self, i: int, rows: Rows, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that new tree i's histograms read: (row, node, g, h)."""
        p, k, tree = self.params, self.objective.size, self.new[i]
        place = tree.place(rows.cells)
        g, h = rows.g, rows.h
        if p.leaf_boosting:  # gradients at the score that this forest's trees so far would give
            scored = rows.raw.copy()
            for j in range(i - i % k, i - i % k + k):
                scored[:, j % k] += p.step_size * self.new[j].predict(rows.cells)
            g, h = self.gradients(rows.weight, rows.label, scored)
        flat = tree.flat()
        node = flat["ids"][place]
        use = flat["leaf"][place] & self.sampled(rows.key, part, i)
        scale = self.goss_scale(rows.g, rows.key, i) if self.goss is not None else None
        if scale is not None:
            use &= scale > 0
        if p.sub_sample_rate_by_node < 1 and p.histogram_computation_type != "subtract":
            for n in np.unique(node[use]):
                mine = node == n
                use[mine] &= keep_array(p.sub_sample_rate_by_node, mixed_seed(self.seed, 3, i, int(n)), rows.key[mine])
        at = np.flatnonzero(use)
        gs, hs = g[at, i % k], h[at, i % k]
        return (at, node[at], gs, hs) if scale is None else (at, node[at], gs * scale[at], hs * scale[at])


def unit_of(p: Params, key: np.ndarray, part: int) -> np.ndarray:
    return {"row": key, "block": key // p.block_size, "partition": np.full(len(key), part)}[p.sub_sample_type]


def unit_seed(seed: int, base: int) -> int:
    return mixed_seed(seed, 1, base)


def local_histograms(round_: Round, wanted: set[tuple[int, int]], picked: set[tuple[int, int, int]] | None):
    """Of one partition: {(tree, node, column): [g by bin, h by bin]}. wanted: (tree, node); picked: (tree, node, column)."""
    size = round_.params.max_bins

    def run(rows: Iterable[Rows], part: int) -> dict[tuple[int, int, int], np.ndarray]:
        out: dict[tuple[int, int, int], np.ndarray] = {}
        for r in rows:
            some = r.cells.columns()
            for i in range(len(round_.new)):
                nodes = np.array(sorted(n for t, n in wanted if t == i), np.int64)
                if not len(nodes):
                    continue
                at, node, g, h = round_.placed(i, r, part)
                inside = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                ok = nodes[inside] == node
                if not ok.all():
                    at, inside, g, h = at[ok], inside[ok], g[ok], h[ok]
                if not len(at):
                    continue
                totals = np.stack([np.bincount(inside, weights=w, minlength=len(nodes)) for w in (g, h)])
                here = [(j, int(nodes[j])) for j in np.flatnonzero(np.bincount(inside, minlength=len(nodes)))]
                for c in round_.columns[i]:
                    if picked is not None and not any((i, n, c) in picked for _, n in here):
                        continue
                    if some is None or c in some:
                        both = r.cells.sums(c, at, inside, len(nodes), size, [g, h], totals)
                    else:  # nothing but missing cells
                        both = np.zeros((2, len(nodes), size))
                        both[:, :, 0] = totals
                    for j, n in here:
                        if picked is not None and (i, n, c) not in picked:
                            continue
                        if (i, n, c) in out:
                            out[i, n, c] += both[:, j]
                        else:
                            out[i, n, c] = both[:, j].copy()
        return out

    return run


TALLY = "i int, v long, n long"


def norm_key(norm: np.ndarray) -> np.ndarray:
    """64 bits in the order of norms, which are not negative; nothing is above NaN."""
    return (np.where(np.isnan(norm), np.nan, norm) + 0.0).view(np.uint64)


def tally_batches(arrays: Iterable[np.ndarray], pick: Callable[[int, np.ndarray], np.ndarray], of: list[int], most: int = 64) -> Iterator[pa.RecordBatch]:
    """What ``pick`` takes of one partition's arrays for each i, counted: (i, v, n)."""
    parts: dict[int, list] = {i: [] for i in of}
    for x in arrays:
        for i, mine in parts.items():
            mine.append(np.unique(pick(i, x), return_counts=True))
            if len(mine) >= most:
                mine[:] = [tallied(mine)]
    for i, mine in parts.items():
        v, n = tallied(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(n)], names=["i", "v", "n"])


HIST = "tree int, node long, col int, kind int, hist binary"


def hist_batches(found: dict, kind: int = 0) -> Iterator[pa.RecordBatch]:
    items = list(found.items())
    for at in range(0, len(items), 4096):
        some = items[at : at + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in some], pa.int32()), pa.array([k[1] for k, _ in some], pa.int64()), pa.array([k[2] for k, _ in some], pa.int32()),
             pa.array([kind] * len(some), pa.int32()), pa.array([v.tobytes() for _, v in some], pa.binary())],
            names=["tree", "node", "col", "kind", "hist"],
        )


def summed(batches: Iterable[pa.RecordBatch], size: int) -> dict[tuple[int, int, int], np.ndarray]:
    out: dict[tuple[int, int, int], np.ndarray] = {}
    for rows in batches:
        for t, n, c, h in zip(*(rows.column(x).to_pylist() for x in ("tree", "node", "col", "hist")), strict=True):
            h = np.frombuffer(h, float).reshape(2, size)
            out[t, n, c] = out[t, n, c] + h if (t, n, c) in out else h
    return out


def children(old: dict, right: dict, active: set[tuple[int, int]]) -> dict:
    """Histograms of the next level: those of right children, keyed by the parent, are given; left ones are the rest of it."""
    out = {}
    for (t, n, c), h in old.items():
        r = right.get((t, n, c))
        if (t, 2 * n) in active:
            out[t, 2 * n, c] = h if r is None else h - r
        if r is not None and (t, 2 * n + 1) in active:
            out[t, 2 * n + 1, c] = r
    return out


def long_histograms(hists: DataFrame, size: int) -> DataFrame:
    """Packed histograms as rows (tree_id, node_id, col_id, bin, g, h) of filled bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, n, c, h in zip(*(b.column(x).to_pylist() for x in ("tree", "node", "col", "hist")), strict=True):
                h = np.frombuffer(h, float).reshape(2, size)
                bins = np.flatnonzero((h != 0).any(axis=0))
                cols = [np.full(len(bins), t, np.int32), np.full(len(bins), n, np.int64), np.full(len(bins), c, np.int32), bins.astype(np.int32), h[0, bins], h[1, bins]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["tree_id", "node_id", "col_id", "bin", "g", "h"])

    return hists.mapInArrow(run, "tree_id int, node_id long, col_id int, bin int, g double, h double")


SPLIT = "tree int, node long, col int, missing_go boolean, is_seq boolean, data array<int>, left_first boolean, gain double, stats array<double>"


def search(params: Params, bases: dict[tuple[int, int], float], columns_by_node: Callable[[int, int], set | None]):
    """Best split of each node among one partition's histograms."""
    size, categorical = params.max_bins, set(params.cat_cols)

    def best(hists: dict) -> pa.RecordBatch:
        found: dict[tuple[int, int], Split] = {}
        for (t, n, c), h in sorted(hists.items()):
            allowed = columns_by_node(t, n)
            if allowed is not None and c not in allowed:
                continue
            s = best_split(c, h[0], h[1], c in categorical, params, bases.get((t, n), 0.0))
            if s is not None and ((t, n) not in found or s.gain > found[t, n].gain):
                found[t, n] = s
        rows = list(found.items())
        arrays = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], *([getattr(s, a) for _, s in rows] for a in ("col", "missing_go", "is_seq")), [list(s.data) for _, s in rows],
                  [s.left for _, s in rows], [s.gain for _, s in rows], [[s.wl, s.gl, s.hl, s.wr, s.gr, s.hr] for _, s in rows]]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=["tree", "node", "col", "missing_go", "is_seq", "data", "left_first", "gain", "stats"])

    return best


class Booster:
    """One fit. ``data``: (key long, bins array<int>, label double, weight double, raw array<double>), and cols array<int>
    with the columns of the bins where they are sparse. ``local``: whether the driver may hold a small table."""

    def __init__(self, data: DataFrame, discretizer: Discretizer, objective: Objective, raw_base: list[float], params: Params,
                 metrics: list[Metric] = (), callbacks: list = (), valid: DataFrame | None = None, trees: list[Tree] = (), weights: list[float] = (), local: bool = True):
        self.data, self.valid, self.discretizer, self.objective, self.raw_base = data, valid, discretizer, objective, raw_base
        self.params, self.metrics, self.callbacks = params, list(metrics), list(callbacks)
        self.trees, self.weights, self.since = list(trees), list(weights), 0
        self.history: dict[str, list[dict[str, float]]] = {"train": [], "valid": []}
        spark = data.sparkSession
        p = params.histogram_parallelism
        self.tasks = p if p > 0 else -p * tasks_for(spark)
        self.parts, self.cores = data.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
        self.held: dict[str, list[tuple[int, list[Rows]]]] | None = None
        self.vertical = None
        self.written = [data, valid]
        if local and params.parallelism_type == "data" and self._bytes() <= LOCAL_BYTES:
            self._hold()
        elif getattr(data, "_written_at", None):
            self.data = data.persist(storage(params.storage_level1))
            self.valid = valid.persist(storage(params.storage_level2)) if valid is not None else None

    def close(self) -> None:
        """Delete the written tables of this fit."""
        for table in (self.data, self.valid):
            if table is not None and table.is_cached:
                table.unpersist()
        for table in (*self.written, self.data, self.valid):
            release(table)

    # -- where the rows are ----------------------------------------------------------------------------------------

    def _bytes(self) -> int:
        """Of the tables as the driver would hold them. Rows are counted from the files' footers, cells only of few sparse rows."""
        if not getattr(self.data, "_written_at", None):
            return LOCAL_BYTES + 1
        total = 0
        for table in (self.data, self.valid):
            if table is None:
                continue
            n, sparse = table.count(), "cols" in table.columns
            total += n * (24 + 8 * len(self.raw_base)) + (0 if sparse else 8 * n * self.discretizer.size)
            if sparse and total <= LOCAL_BYTES:
                total += 24 * table.agg(F.coalesce(F.sum(F.size("bins")), F.lit(0))).first()[0]
        return total

    def _hold(self) -> None:
        first = Round(self.objective, self.raw_base, self.trees, self.weights, 0, params=self.params)
        self.held = {}
        for name in ("data", "valid"):
            table = getattr(self, name)
            if table is None:
                continue
            parts: dict[int, list[pa.RecordBatch]] = {}
            for b in table.withColumn("_part", F.spark_partition_id()).toArrow().to_batches():
                ids = b.column("_part").to_numpy()
                for part in np.unique(ids):
                    parts.setdefault(int(part), []).append(b.filter(pa.array(ids == part)))
            joined = {part: pa.Table.from_batches(bs).combine_chunks().to_batches() for part, bs in sorted(parts.items())}
            self.held[name] = [(part, list(first.rows(bs))) for part, bs in joined.items()]
        self.base = {name: [[r.raw.copy() for r in rows] for _, rows in parts] for name, parts in self.held.items()} if self.params.boost_type == "dart" else None

    def _score_held(self, round_: Round, new: list[Tree], weights: list[float]) -> None:
        """Bring the raw scores of held rows up to date: by the new trees, or, where weights of old ones change, from the base."""
        for name, parts in self.held.items():
            for i, (_, rows) in enumerate(parts):
                for j, r in enumerate(rows):
                    if self.base is not None:
                        r.raw = self.base[name][i][j].copy()
                    for t, (tree, w) in enumerate(zip(new, weights, strict=True)):
                        if w:
                            r.raw[:, t % r.raw.shape[1]] += w * tree.predict(r.cells)
                    round_.with_gradients(r)

    def each(self, round_: Round, run, schema: str, name: str = "data") -> DataFrame | list[pa.RecordBatch]:
        """``run(rows, partition)`` over every partition: a query, or its batches where the rows are held."""
        if self.held is not None:
            return [b for part, rows in self.held[name] for b in run(rows, part)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            yield from run(round_.rows(batches), TaskContext.get().partitionId())

        return getattr(self, name).mapInArrow(task, schema)

    @staticmethod
    def gathered(found: DataFrame | list[pa.RecordBatch]) -> list[dict]:
        return [r for b in found for r in b.to_pylist()] if isinstance(found, list) else [r.asDict() for r in found.collect()]

    # -- one level -------------------------------------------------------------------------------------------------

    def active(self, round_: Round, done: set[int] = frozenset()) -> set[tuple[int, int]]:
        """(tree, node) of the deepest leaves of the growing trees."""
        return {(i, n.id) for i, t in enumerate(round_.new) if i not in done for n in t.leaves if n.id.bit_length() - 1 == round_.depth}

    def columns_by_node(self, round_: Round) -> Callable[[int, int], set | None]:
        p, seed, depth, columns = self.params, round_.seed, round_.depth, round_.columns

        def of(t: int, n: int) -> set | None:
            if p.col_sample_rate_by_node >= 1:
                return None
            mine = columns[t]
            return {mine[i] for i in choose_columns(len(mine), p.col_sample_rate_by_node, mixed_seed(seed, 4, t, n, depth))}

        return of

    def _combined(self, hists: DataFrame) -> DataFrame:
        """Histograms of many partitions added up in groups, so that what is dealt to the search is few for each key."""
        size, parts = self.params.max_bins, self.parts
        for _ in range(self.params.aggregation_depth - 1):
            groups = -(-parts // max(2, self.cores))
            if groups <= 1 or parts <= 4 * self.cores:
                return hists

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from hist_batches(summed(batches, size))

            hists = hists.withColumn("group", F.spark_partition_id() % groups).repartition(self.tasks * min(groups, 8), "group", "tree", "node", "col").drop("group").mapInArrow(add, HIST)
            parts = groups
        return hists

    def histograms(self, round_: Round, active: set, parent=None):
        """Histograms of the active nodes: a query, or a dictionary where the rows are held. parent: those of the level
        before, for subtraction, which computes right children alone."""
        p, size = self.params, self.params.max_bins
        if self.held is None and p.parallelism_type == "feature":
            return self.vertical.histograms(round_, active)
        picked = self.vote(round_, active) if p.histogram_computation_type == "vote" else None
        subtract = parent is not None
        local = local_histograms(round_, {(t, n) for t, n in active if n % 2 == 1} if subtract else active, picked)
        found = self.each(round_, lambda rows, part: hist_batches(local(rows, part)), HIST)
        if self.held is not None:
            mine = summed(found, size)
            return children(parent, {(t, n >> 1, c): h for (t, n, c), h in mine.items()}, active) if subtract else mine
        found = self._combined(found)
        if not subtract:
            return found
        found = found.withColumn("node", F.shiftright("node", 1)).withColumn("kind", F.lit(1)).unionByName(parent)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list] = {0: [], 1: []}
            for rows in batches:
                kinds = rows.column("kind").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    parts[k].append(rows.filter(pa.array(kinds == k)))
            yield from hist_batches(children(summed(parts[0], size), summed(parts[1], size), active))

        return found.repartition(self.tasks, "tree", "node", "col").mapInArrow(task, HIST)

    def splits(self, round_: Round, hists, active: set) -> list[dict]:
        """The best splits of the tasks' histograms, at most tasks * 2 ** depth rows a tree."""
        bases = {(i, n.id): n.prediction for i, t in enumerate(round_.new) for n in t.leaves} if self.params.leaf_boosting else {}
        size, best = self.params.max_bins, search(self.params, bases, self.columns_by_node(round_))
        if isinstance(hists, dict):
            return best(hists).to_pylist()
        if self._few(active, round_.columns):
            # So few histograms that the driver adds them up in the time of starting the tasks that would.
            return best(summed(hists.select("tree", "node", "col", "hist").toArrow().to_batches(), size)).to_pylist()

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield best(summed(batches, size))

        return [r.asDict() for r in hists.repartition(self.tasks, "tree", "node", "col").mapInArrow(task, SPLIT).collect()]

    def level(self, round_: Round, remaining: list[int], done: set[int], parent) -> tuple[dict[int, dict[int, Split]], object]:
        """Best splits of the deepest leaves of the growing trees; and, when subtracting, this level's histograms."""
        active = self.active(round_, done)
        hists = self.histograms(round_, active, parent)
        subtract = self.params.histogram_computation_type == "subtract" and self.vertical is None
        if subtract and not isinstance(hists, dict):
            hists = materialise(hists, "hist")
        found: dict[int, dict[int, Split]] = {}
        for r in self.splits(round_, hists, active):
            s = Split(r["col"], r["missing_go"], r["is_seq"], tuple(r["data"]), r["left_first"], r["gain"], *r["stats"])
            mine = found.setdefault(r["tree"], {})
            old = mine.get(r["node"])
            if old is None or (-s.gain, s.col) < (-old.gain, old.col):
                mine[r["node"]] = s
        for t, mine in found.items():  # the leaf budget takes the splits of most gain
            found[t] = dict(sorted(mine.items(), key=lambda x: (-x[1].gain, x[0]))[: remaining[t]])
        return found, hists if subtract else None

    def _few(self, active: set, columns: list[list[int]]) -> bool:
        """Whether all tasks' histograms of a level are within DRIVER_BYTES."""
        cells = sum(len(columns[t]) for t, _ in active) * self.params.max_bins
        return 16 * cells * self.parts <= DRIVER_BYTES

    def votes(self, round_: Round, active: set) -> dict[tuple[int, int, int], int]:
        """How many partitions vote for a column: each for its top_k by local gain of each node."""
        p, categorical, allow = self.params, set(self.params.cat_cols), self.columns_by_node(round_)
        local = local_histograms(round_, active, None)

        def run(rows: Iterable[Rows], part: int) -> Iterator[pa.RecordBatch]:
            gains: dict[tuple[int, int], list] = {}
            for (t, n, c), h in local(rows, part).items():
                allowed = allow(t, n)
                if allowed is None or c in allowed:
                    s = best_split(c, h[0], h[1], c in categorical, p)
                    if s is not None:
                        gains.setdefault((t, n), []).append((-s.gain, c))
            out = [(t, n, c) for (t, n), found in gains.items() for _, c in sorted(found)[: p.top_k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))], names=["tree", "node", "col"])

        found = self.each(round_, run, "tree int, node long, col int")
        count: dict[tuple[int, int, int], int] = {}
        if isinstance(found, DataFrame):  # at most 2 ** depth * columns rows a tree
            return {(t, n, c): k for t, n, c, k in found.groupBy("tree", "node", "col").count().collect()}
        for r in self.gathered(found):
            count[r["tree"], r["node"], r["col"]] = count.get((r["tree"], r["node"], r["col"]), 0) + 1
        return count

    def vote(self, round_: Round, active: set) -> set[tuple[int, int, int]]:
        """Of the columns voted for, the 2 * top_k of most votes of each node."""
        by: dict[tuple[int, int], list] = {}
        for (t, n, c), k in self.votes(round_, active).items():
            by.setdefault((t, n), []).append((-k, c))
        return {(t, n, c) for (t, n), found in by.items() for _, c in sorted(found)[: 2 * self.params.top_k]}

    # -- one round -------------------------------------------------------------------------------------------------

    def _columns(self, seed: int, trees: int) -> list[list[int]]:
        per = [choose_columns(self.discretizer.size, self.params.col_sample_rate_by_tree, mixed_seed(seed, 5, b)) for b in range(-(-trees // self.objective.size))]
        return [per[i // self.objective.size] for i in range(trees)]

    def _drop(self, rng: random.Random) -> list[int]:
        """Base models left out this round."""
        p = self.params
        n = len(self.trees) // self.objective.size
        if p.boost_type != "dart" or not n or rng.random() < p.drop_skip:
            return []
        k = min(max(-int(-n * p.drop_rate // 1), p.min_drop), p.max_drop, n)
        return sorted(rng.sample(range(n), k))

    def goss_level(self, round_: Round) -> list[float] | None:
        """The norm at the place where the top rows begin, of all rows in order; exact."""
        if self.params.sub_sample_type != "goss":
            return None

        def norms(rows: Iterable[Rows], part: int) -> Iterator[np.ndarray]:
            for r in rows:
                yield norm_key((r.g * r.g).sum(axis=1))

        def scan(pick, of: list[int]) -> dict:
            return self._tallies(self.each(round_, lambda rows, part: tally_batches(norms(rows, part), pick, of), TALLY), of)

        rows = sum(len(r) for _, held in self.held["data"] for r in held) if self.held is not None else self.data.count()
        if not rows:
            return [0.0]
        return [float(np.array([kth_least(scan, [max(1, share(rows, 1 - self.params.top_rate))])[0]], np.uint64).view(float)[0])]

    @staticmethod
    def _tallies(found: DataFrame | list[pa.RecordBatch], of: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Tasks' tallies added up: {i: (values, counts)}; of each i 65,536 values at most."""
        if isinstance(found, DataFrame):
            found = found.groupBy("i", "v").agg(F.sum("n").alias("n")).toArrow().to_batches()
        parts: dict[int, list] = {i: [] for i in of}
        for b in found:
            which, v, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "v", "n"))
            for i in of:
                parts[i].append((v[which == i].view(np.uint64), n[which == i]))
        return {i: tallied(x) for i, x in parts.items()}

    def _units(self, seed: int, base_models: int) -> list[int] | None:
        """Of each base model the greatest hash of the units sampled, which are exactly the share of all, however many there are."""
        p = self.params
        if p.sub_sample_rate_by_tree >= 1 or p.sub_sample_type == "goss":
            return None
        if not hasattr(self, "_all_units"):
            if self.held is not None:
                self._all_units = np.unique(np.concatenate([np.zeros(0, np.int64), *(unit_of(p, r.key, part) for part, rows in self.held["data"] for r in rows)]))
            elif p.sub_sample_type == "partition":
                self._all_units = np.arange(self.parts)
            else:
                def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for b in batches:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(unit_of(p, b.column(0).to_numpy(zero_copy_only=False), 0)))], names=["u"])

                self._all_units = materialise(self.data.select("key").mapInArrow(units, "u long").distinct(), "units")
                self.written.append(self._all_units)
            self._unit_count = self._all_units.count() if isinstance(self._all_units, DataFrame) else len(self._all_units)
        every, seeds, k = self._all_units, [unit_seed(seed, b) for b in range(base_models)], share(self._unit_count, p.sub_sample_rate_by_tree)
        if not k:
            return [-1] * base_models
        if isinstance(every, np.ndarray):
            return [int(np.partition(hashed(s, every), k - 1)[k - 1]) for s in seeds]

        def scan(pick, of: list[int]) -> dict:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from tally_batches((b.column(0).to_numpy() for b in batches), lambda i, u: pick(i, hashed(seeds[i], u)), of)

            return self._tallies(every.mapInArrow(run, TALLY), of)

        return kth_least(scan, [k] * base_models)

    def _root_weights(self, round_: Round) -> None:
        """Leaf boosting: the root has a weight of its own."""

        def roots(rows: Iterable[Rows], part: int) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(round_.new)))
            for r in rows:
                for t in range(len(round_.new)):
                    _, _, g, h = round_.placed(t, r, part)
                    sums[:, t] += g.sum(), h.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(round_.new), dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=["t", "g", "h"])

        found = self.each(round_, roots, "t int, g double, h double")
        found = found.groupBy("t").agg(F.sum("g").alias("g"), F.sum("h").alias("h")) if isinstance(found, DataFrame) else found
        sums = np.zeros((2, len(round_.new)))
        for r in self.gathered(found):
            sums[:, r["t"]] += r["g"], r["h"]
        for t, tree in enumerate(round_.new):
            tree.nodes[1].prediction = float(np.nan_to_num(leaf_weight(sums[0, t], sums[1, t], self.params.reg_lambda, self.params.reg_alpha)))
            tree._flat = None

    def start(self, iteration: int) -> tuple[Round, list[int]]:
        """The round of an iteration, and the base models that it drops."""
        p, k = self.params, self.objective.size
        seed = mixed_seed(p.seed, iteration)
        dropped = self._drop(random.Random(mixed_seed(seed, 6)))
        working = [0.0 if t // k in dropped else w for t, w in enumerate(self.weights)]
        count = k * p.forest_size
        round_ = Round(self.objective, self.raw_base, self.trees, working, self.since, [Tree() for _ in range(count)], self._columns(seed, count), p, seed)
        if self.held is not None and self.base is not None:
            self._score_held(round_, self.trees, working)
        round_.units = self._units(seed, p.forest_size)
        round_.goss = self.goss_level(round_)
        if p.parallelism_type == "feature" and self.held is None:
            from arborlane.plans.vertical import Vertical

            if self.vertical is None or self.vertical.since != self.since:  # raw scores were folded anew
                self.vertical = Vertical(self)
        return round_, dropped

    def one_round(self, iteration: int) -> list[Tree]:
        p = self.params
        round_, dropped = self.start(iteration)
        count = len(round_.new)
        if p.leaf_boosting:
            self._root_weights(round_)
        remaining, done, hists = [p.max_leaves - 1] * count, set(), None
        for depth in range(p.max_depth):
            round_.depth = depth
            before = hists
            found, hists = self.level(round_, remaining, done, before)
            release(before)
            for t in range(count):
                mine = found.get(t, {})
                if mine:
                    round_.new[t].grow(mine, additive=p.leaf_boosting)
                    remaining[t] -= len(mine)
                if not mine or remaining[t] <= 0:
                    done.add(t)
            if len(done) == count:
                break
        release(hists)
        new = round_.new
        if all(t.is_empty for t in new):
            return []
        self.append(new, dropped)
        if self.held is not None:
            if self.base is None:
                self._score_held(round_, new, self.weights[-count:])
            else:
                self._score_held(round_, self.trees, self.weights)
        return new

    def append(self, new: list[Tree], dropped: list[int]) -> None:
        self.weights = new_weights(self.weights, len(new), dropped, self.params, self.objective.size)
        self.trees += new

    def _refresh(self) -> None:
        """Fold the trees so far into the raw column of written tables."""
        if self.params.boost_type == "dart" or self.held is not None:
            return
        round_ = Round(self.objective, self.raw_base, self.trees, self.weights, self.since, params=self.params)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in round_.rows([b]):
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, r.raw.size + 1, r.raw.shape[1], dtype=np.int32)), pa.array(r.raw.ravel()))
                    yield b.set_column(b.schema.get_field_index("raw"), "raw", flat)

        for name, level in (("data", self.params.storage_level1), ("valid", self.params.storage_level2)):
            old = getattr(self, name)
            if old is not None:
                new = materialise(old.mapInArrow(scored, old.schema), "scored")
                self.written.append(new)
                setattr(self, name, new.persist(storage(level)))
                if old.is_cached:
                    old.unpersist()
                release(old)
        self.since = len(self.trees)

    def evaluate(self, name: str = "data") -> dict[str, float]:
        """All metrics: sums of those that partitions add up in one pass, and the others over a table of scores."""
        round_ = Round(self.objective, self.raw_base, self.trees, self.weights, self.since, params=self.params)
        adding = [m for m in self.metrics if not m.batch]
        scored = lambda rows: ((r.weight, r.label, r.raw, round_.objective.transform(r.raw)) for r in rows)
        out = {}
        if adding:
            found = self.each(round_, lambda rows, part: partials(adding, scored(rows)), "m int, s binary, shape array<int>", name)
            out = totalled(adding, self.gathered(found))  # a row for each partition and metric
        if len(adding) < len(self.metrics):

            def table(rows: Iterable[Rows], part: int) -> Iterator[pa.RecordBatch]:
                for x in scored(rows):
                    yield measured(*x)

            found = self.each(round_, table, "weight double, label array<double>, raw array<double>, score array<double>", name)
            spark = getattr(self, name).sparkSession
            df = spark.createDataFrame(pa.Table.from_batches(found)) if isinstance(found, list) else materialise(found, "scores")
            out |= {m.name: float(m.compute(df)) for m in self.metrics if m.batch}
            release(df)
        return {m.name: out[m.name] for m in self.metrics if m.name in out}

    def run(self, snapshot: Callable[[], object]) -> None:
        try:
            for iteration in range(self.params.max_iter):
                if not self.one_round(iteration):
                    break
                every = self.params.checkpoint_interval
                if every > 0 and (iteration + 1) % every == 0 and iteration + 1 < self.params.max_iter:
                    self._refresh()
                if self.metrics:
                    self.history["train"].append(self.evaluate("data"))
                    if self.valid is not None:
                        self.history["valid"].append(self.evaluate("valid"))
                stop = [c.compute(self.params, snapshot(), iteration + 1, self.history["train"], self.history["valid"]) for c in self.callbacks]
                if any(stop):
                    break
        finally:
            for c in self.callbacks:
                c.close()


def storage(name: str) -> StorageLevel:
    """The level of a name; serialized forms are those Python tables have anyway."""
    return getattr(StorageLevel, name.replace("_SER", ""))


def new_weights(weights: list[float], added: int, dropped: list[int], params: Params, size: int) -> list[float]:
    """Tree weights after a round. gbtree: the step. dart: 1 without drops, else 1 / (k + step), the dropped shrunk by k / (k + step)."""
    if params.boost_type != "dart":
        return [*weights, *[params.step_size] * added]
    k = len(dropped)
    if not k:
        return [*weights, *[1.0] * added]
    out = [w * k / (k + params.step_size) if t // size in dropped else w for t, w in enumerate(weights)]
    return [*out, *[1.0 / (k + params.step_size)] * added]


def prepare(df: DataFrame, discretizer: Discretizer, features: list[Column], label: Column, weight: Column, raw_base: list[float], key: Column | None = None,
            array: Column | None = None, sparse: Column | None = None) -> DataFrame:
    """The binned table of a fit, written once. key: a stable row key for sampling; without one the row's place in the
    written table is taken, which is stable from then on but depends on the input's partitions. sparse: the features as a
    vector, of which filled cells alone are binned and kept."""
    key = key.cast("long") if key is not None else F.monotonically_increasing_id()
    more = [label.cast("double").alias("label"), weight.cast("double").alias("weight"), F.array(*map(F.lit, raw_base)).cast("array<double>").alias("raw")]
    if sparse is not None:
        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                first, cols, bins = discretizer.sparse_bins(rows.column("v"))
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (cols, bins)]
                yield pa.RecordBatch.from_arrays([rows.column("key"), *lists, *(rows.column(c) for c in ("label", "weight", "raw"))], names=["key", "cols", "bins", "label", "weight", "raw"])

        rows = df.select(key.alias("key"), sparse.alias("v"), *more)
        rows = rows.mapInArrow(filled, "key long, cols array<int>, bins array<int>, label double, weight double, raw array<double>")
    elif array is not None and discretizer.size > WIDE:
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                x = matrix(rows.column("bins"), discretizer.size)
                bins = np.stack([discretizer.bin_array(i, x[:, i]) for i in range(x.shape[1])], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, x.shape[1], dtype=np.int32)), pa.array(bins.ravel()))
                yield rows.set_column(1, "bins", flat)

        rows = df.select(key.alias("key"), array.alias("bins"), *more)
        rows = rows.mapInArrow(binned, "key long, bins array<int>, label double, weight double, raw array<double>")
    else:
        rows = df.select(key.alias("key"), discretizer.transform(features).alias("bins"), *more)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < 2 * cores:  # few files: let every core have a share
        rows = rows.repartition(cores)
    return materialise(rows, "binned")


__all__ = ["Booster", "Round", "Square", "mixed_seed", "new_weights", "prepare"]
