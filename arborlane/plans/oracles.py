"""SQL of whole fits, written from the definitions: a chain of tables for each tree and level. It runs no code of the library.

Rows are (id, b0, b1, .., y, w): bins, label, weight. Each tree's predictions become a column t0, t1, .. of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


def width_bins(table: str, columns: list[str], key: str, label: str, weight: str = "1.0", bins: int = 16, more: str = "") -> str:
    """CTEs up to ``rows0``: equal-width bins of columns without missing values."""
    m = bins - 1
    ends = ", ".join(f"MIN({c})::DOUBLE AS lo{i}, MAX({c})::DOUBLE AS hi{i}" for i, c in enumerate(columns))
    cells = ", ".join(
        f"CASE WHEN hi{i} = lo{i} OR {c} <= lo{i} + (hi{i} - lo{i}) / {m - 1} / 2 THEN 1 "
        f"ELSE LEAST(1 + CAST(CEIL(({c} - (lo{i} + (hi{i} - lo{i}) / {m - 1} / 2)) / ((hi{i} - lo{i}) / {m - 1})) AS INT), {m}) END AS b{i}"
        for i, c in enumerate(columns)
    )
    return f"ends AS MATERIALIZED (SELECT {ends} FROM {table}), rows0 AS MATERIALIZED (SELECT {key} AS id, {cells}, ({label})::DOUBLE AS y, ({weight})::DOUBLE AS w{more} FROM {table}, ends)"


def square(raws: list[str]) -> list[tuple[str, str]]:
    return [(f"w * ({raws[0]} - y)", "w")]


def logistic(raws: list[str]) -> list[tuple[str, str]]:
    p = f"(1 / (1 + EXP(-({raws[0]}))))"
    return [(f"w * ({p} - y)", f"w * GREATEST({p} * (1 - {p}), 1e-16)")]


def softmax(raws: list[str]) -> list[tuple[str, str]]:
    total = " + ".join(f"EXP({r})" for r in raws)
    each = [f"(EXP({r}) / ({total}))" for r in raws]
    return [(f"w * ({p} - CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END)", f"w * GREATEST(2 * {p} * (1 - {p}), 1e-16)") for k, p in enumerate(each)]


@dataclass
class FitSql:
    """``rows``: CTEs up to rows0. ``base``: raw base of each output, SQL over rows0 in brackets. Functions take a round and a
    tree's number; ``working`` gives the weights of earlier trees that a round's gradients see, ``final`` those at the end."""

    rows: str
    columns: int
    base: list[str]
    rounds: int = 2
    depth: int = 2
    step: float = 0.5
    lam: float = 1.0
    least: float = 1.0
    outputs: int = 1
    forest: int = 1
    loss: Callable[[list[str]], list[tuple[str, str]]] = square
    allowed: Callable[[int, int], list[int]] | None = None
    sampled: Callable[[int, int], str] = lambda r, t: "TRUE"
    scale: Callable[[int, int], str] = lambda r, t: "1.0"
    before: Callable[[int], str] = lambda r: ""  # further CTEs of a round, over its rows with gradients g{k}
    working: Callable[[int], list[float]] | None = None
    final: list[float] | None = None
    leaves: int | None = None  # budget of a tree
    leafwise: bool = False

    def raw(self, weights: list[float], output: int) -> str:
        terms = [f"{w!r} * t{t}" for t, w in enumerate(weights) if t % self.outputs == output and w]
        return " + ".join([self.base[output], *terms])

    def weights(self, trees: int) -> list[float]:
        return [self.step] * trees

    def _score(self, g: str, h: str, b: str) -> str:
        return f"POWER({g} + {self.lam} * {b}, 2) / (2 * ({h} + {self.lam}))"

    def _weight(self, g: str, h: str, b: str) -> str:
        return f"-({g} + {self.lam} * {b}) / ({h} + {self.lam})"

    def _tree(self, r: int, i: int, t: int) -> str:
        """CTEs of tree t, the i-th of round r, up to x{t}_{depth}."""
        k = i % self.outputs
        cols = self.allowed(r, i) if self.allowed else range(self.columns)
        use = self.sampled(r, i)
        s = self.scale(r, i)
        root = "0.0"
        out = []
        if self.leafwise:
            out.append(f"root{t} AS MATERIALIZED (SELECT -SUM(g{k}) / (SUM(h{k}) + {self.lam}) AS v FROM y{r} WHERE {use})")
            root = f"(SELECT v FROM root{t})"
        out.append(f"x{t}_0 AS MATERIALIZED (SELECT *, g{k} * {s} AS g, h{k} * {s} AS h, 1 AS node, ({root})::DOUBLE AS pred, TRUE AS open, ({use}) AND {s} > 0 AS used FROM y{r})")
        for d in range(self.depth):
            x = f"x{t}_{d}"
            if self.leafwise:
                raws = [f"{self.raw(self.weights(r * self.outputs * self.forest), 0)} + {self.step} * pred"]
                (g, h), = self.loss(raws)
                out.append(f"z{t}_{d} AS MATERIALIZED (SELECT * REPLACE ({g} AS g, {h} AS h) FROM {x})")
                x = f"z{t}_{d}"
            cells = " UNION ALL ".join(f"SELECT node, pred, {c} AS col, b{c} AS bin, g, h FROM {x} WHERE open AND used" for c in cols)
            b = "pred" if self.leafwise else "0.0"
            out.append(f"h{t}_{d} AS MATERIALIZED (SELECT node, MAX(pred) AS pred, col, bin, SUM(g) AS g, SUM(h) AS h FROM ({cells}) GROUP BY node, col, bin)")
            out.append(
                f"c{t}_{d} AS MATERIALIZED (SELECT node, pred, col, bin, SUM(g) OVER u AS gl, SUM(h) OVER u AS hl, SUM(g) OVER v AS gt, SUM(h) OVER v AS ht, bin = MAX(bin) OVER v AS last_ "
                f"FROM h{t}_{d} WINDOW u AS (PARTITION BY node, col ORDER BY bin), v AS (PARTITION BY node, col))"
            )
            gain = f"{self._score('gl', 'hl', b)} + {self._score('(gt - gl)', '(ht - hl)', b)} - {self._score('gt', 'ht', b)}"
            out.append(
                f"k{t}_{d} AS MATERIALIZED (SELECT *, {self._weight('gl', 'hl', b)} AS wl, {self._weight('(gt - gl)', '(ht - hl)', b)} AS wr, hl >= ht - hl AS first_left FROM "
                f"(SELECT *, {gain} AS gain FROM c{t}_{d} WHERE NOT last_ AND hl >= {self.least} AND ht - hl >= {self.least}) WHERE gain >= 0)"
            )
            budget = ""
            if self.leaves is not None:
                spent = " + ".join([f"(SELECT COUNT(*) FROM s{t}_{e})" for e in range(d)] or ["0"])
                budget = f" QUALIFY ROW_NUMBER() OVER (ORDER BY gain DESC, node) <= {self.leaves - 1} - ({spent})"
            out.append(f"s{t}_{d} AS MATERIALIZED (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, col, bin) AS rank_ FROM k{t}_{d}) WHERE rank_ = 1{budget})")
            bin_of = "CASE s.col " + " ".join(f"WHEN {c} THEN x.b{c}" for c in range(self.columns)) + " END"
            go = f"({bin_of} <= s.bin)"
            value = f"CASE WHEN {go} THEN s.wl ELSE s.wr END" + (" + x.pred" if self.leafwise else "")
            kept = "EXCLUDE (node, pred, open)"
            out.append(
                f"x{t}_{d + 1} AS MATERIALIZED (SELECT x.* {kept}, CASE WHEN s.node IS NULL THEN x.node WHEN {go} = s.first_left THEN 2 * x.node ELSE 2 * x.node + 1 END AS node, "
                f"CASE WHEN s.node IS NULL THEN x.pred ELSE {value} END AS pred, s.node IS NOT NULL AS open FROM {x} x LEFT JOIN s{t}_{d} s ON x.node = s.node AND x.open)"
            )
        return ", ".join(out)

    def ctes(self) -> str:
        """All CTEs up to ``rows{rounds}``, whose columns t0, t1, .. are the trees' predictions."""
        out, trees = [self.rows], 0
        per = self.outputs * self.forest
        for r in range(self.rounds):
            weights = self.working(r) if self.working else self.weights(trees)
            grads = self.loss([self.raw(weights, k) for k in range(self.outputs)])
            out.append(f"y{r} AS MATERIALIZED (SELECT *, " + ", ".join(f"{g} AS g{k}, {h} AS h{k}" for k, (g, h) in enumerate(grads)) + f" FROM rows{r})")
            more = self.before(r)
            if more:
                out.append(more)
            mine = range(trees, trees + per)
            out += [self._tree(r, t - trees, t) for t in mine]
            joins = " ".join(f"JOIN x{t}_{self.depth} x{t} ON x{t}.id = rows{r}.id" for t in mine)
            out.append(f"rows{r + 1} AS MATERIALIZED (SELECT rows{r}.*, " + ", ".join(f"x{t}.pred AS t{t}" for t in mine) + f" FROM rows{r} {joins})")
            trees += per
        return "WITH " + ", ".join(out)

    @property
    def trees(self) -> int:
        return self.rounds * self.outputs * self.forest

    def final_raw(self, output: int = 0, first: int | None = None) -> str:
        weights = self.final or self.weights(self.trees)
        return self.raw(weights[:first], output)

    def scores(self, digits: int = 4) -> str:
        return f"{self.ctes()} SELECT id, ROUND({self.final_raw()}, {digits}) AS prediction FROM rows{self.rounds}"

    def splits(self) -> str:
        """A table (tree, col, gain) of all splits."""
        return " UNION ALL ".join(f"SELECT {t} AS tree, node, col, gain FROM s{t}_{d}" for t in range(self.trees) for d in range(self.depth))


def hashed(key: str, salt: int) -> str:
    """The 64-bit sampling hash of a key, which must not be negative."""
    def wide(e: str, c: int) -> str:
        return f"((({e})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    x = f"xor(({key})::UBIGINT, {salt}::UBIGINT)"
    for shift, c in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = wide(f"xor({x}, {x} >> {shift})", c)
    return f"xor({x}, {x} >> 31)"


def mix64(x: int) -> int:
    mask = (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
    return x ^ x >> 31


def seed_of(*parts: int) -> int:
    """The seed that a sampling step has from the fit's seed, the round and its own numbers."""
    mask = (1 << 64) - 1
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ (p & mask)) * 0xBF58476D1CE4E5B9) & mask
        x ^= x >> 29
    return x
