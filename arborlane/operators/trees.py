"""Trees: growth records, flat arrays for vectorised routing, and rows for tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from arborlane.operators.cells import Dense, Sparse
from arborlane.operators.splits import Split


@dataclass
class Node:
    """The root has id 1, children 2n and 2n + 1."""

    id: int
    prediction: float = 0.0
    split: Split | None = None
    left: Node | None = None
    right: Node | None = None

    @property
    def is_leaf(self) -> bool:
        return self.split is None


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=lambda: {1: Node(1)})
    _flat: dict | None = field(default=None, repr=False, compare=False)

    def grow(self, splits: dict[int, Split], additive: bool = False) -> None:
        """Give nodes their splits and children. additive: a child's prediction adds to its parent's."""
        for i, s in splits.items():
            node = self.nodes[i]
            base = node.prediction if additive else 0.0
            node.split = s
            node.left, node.right = Node(2 * i, base + s.wl), Node(2 * i + 1, base + s.wr)
            self.nodes[2 * i], self.nodes[2 * i + 1] = node.left, node.right
        self._flat = None

    @property
    def leaves(self) -> list[Node]:
        """By node id; a leaf's place is its leaf id."""
        return [self.nodes[i] for i in sorted(self.nodes) if self.nodes[i].is_leaf]

    @property
    def is_empty(self) -> bool:
        return len(self.nodes) == 1 and self.nodes[1].prediction == 0.0

    @property
    def depth(self) -> int:
        return max(i.bit_length() for i in self.nodes) - 1

    def flat(self) -> dict:
        """Arrays by place in id order."""
        if self._flat is None:
            ids = sorted(self.nodes)
            at = {i: k for k, i in enumerate(ids)}
            n = len(ids)
            bins = max((max(s.data, default=0) for x in self.nodes.values() if (s := x.split)), default=0) + 1
            f = {k: np.zeros(n, t) for k, t in (("col", np.int64), ("cut", np.int64), ("missing", bool), ("seq", bool), ("toleft", bool), ("left", np.int64), ("right", np.int64), ("leaf", bool), ("prediction", float), ("leaf_id", np.int64))}
            f["ids"], f["depth"] = np.array(ids, np.int64), self.depth
            sets = any(x.split and not x.split.is_seq for x in self.nodes.values())
            f["member"] = np.zeros((n, bins + 1), bool) if sets else None
            leaf = 0
            for k, i in enumerate(ids):
                x = self.nodes[i]
                f["prediction"][k], f["leaf"][k] = x.prediction, x.is_leaf
                if x.is_leaf:
                    f["left"][k] = f["right"][k] = k
                    f["leaf_id"][k] = leaf
                    leaf += 1
                    continue
                s = x.split
                f["col"][k], f["missing"][k], f["seq"][k], f["toleft"][k] = s.col, s.missing_go, s.is_seq, s.left
                f["left"][k], f["right"][k] = at[2 * i], at[2 * i + 1]
                if s.is_seq:
                    f["cut"][k] = s.data[0]
                else:
                    f["member"][k, list(s.data)] = True
            self._flat = f
        return self._flat

    def place(self, cells: Dense | Sparse) -> np.ndarray:
        """Place of each row's leaf."""
        f = self.flat()
        at = np.zeros(len(cells), np.int64)
        rows = np.arange(len(cells))
        for _ in range(f["depth"]):
            b = cells.pick(rows, f["col"][at])
            go = b <= f["cut"][at]
            if f["member"] is not None:
                inside = f["member"][at, np.minimum(b, f["member"].shape[1] - 1)] & (b < f["member"].shape[1])
                go = np.where(f["seq"][at], go, inside)
            go = np.where(b == 0, f["missing"][at], go)
            at = np.where(go == f["toleft"][at], f["left"][at], f["right"][at])
        return at

    def predict(self, cells: Dense | Sparse) -> np.ndarray:
        return self.flat()["prediction"][self.place(cells)]

    def leaf_of(self, cells: Dense | Sparse) -> np.ndarray:
        return self.flat()["leaf_id"][self.place(cells)]

    def rows(self) -> list[tuple]:
        """Pre-order rows: (id, prediction, is_leaf, left, right, col, missing_go, is_seq, data, left_first, gain, stats)."""
        out: list[tuple] = []

        def visit(x: Node) -> int:
            me = len(out)
            out.append(())
            if x.is_leaf:
                out[me] = (me, float(x.prediction), True, -1, -1, -1, False, False, [], False, 0.0, [])
            else:
                s = x.split
                a, b = visit(x.left), visit(x.right)
                out[me] = (me, float(x.prediction), False, a, b, s.col, s.missing_go, s.is_seq, list(s.data), s.left, float(s.gain), [float(v) for v in (s.wl, s.gl, s.hl, s.wr, s.gr, s.hr)])
            return me

        visit(self.nodes[1])
        return out

    @staticmethod
    def from_rows(rows: list) -> Tree:
        by = {r[0]: r for r in rows}
        if sorted(by) != list(range(len(by))):
            raise ValueError("node ids must be dense")
        tree = Tree({})

        def visit(row: int, node_id: int) -> Node:
            _, prediction, leaf, a, b, col, missing, seq, data, first, gain, stats = by[row]
            x = tree.nodes[node_id] = Node(node_id, prediction)
            if not leaf:
                x.split = Split(col, missing, seq, tuple(data), first, gain, *stats)
                x.left, x.right = visit(a, 2 * node_id), visit(b, 2 * node_id + 1)
            return x

        visit(0, 1)
        return tree


NODE_SCHEMA = "id int, prediction double, is_leaf boolean, left int, right int, col int, missing_go boolean, is_seq boolean, data array<int>, left_first boolean, gain double, stats array<double>"
