"""Mixing sources to target weights, in DataFrame functions alone.

Temperature mixing: with p the sources' shares of tokens, the weights are q ~ p ** alpha. The exponent is bisected so that
the weights meet a target entropy (in nats, as a share of the greatest possible), or so that no source is repeated more
than a limit while every source is used whole at least once. The weights become token budgets, and budgets become block
permutations: a source's documents lie in blocks by a hash; each epoch permutes the blocks, and the documents within each,
by hashes that depend on the epoch. Full epochs use every document once; the last, partial epoch takes documents in that
order while they fit the budget. Every use has its epoch, its block's place in the epoch and its place in the block.

Counting tokens is one partial aggregation by source. Running totals and places are taken over ``CELLS`` cells of a source's
blocks and then within a cell, and within a block, which holds about ``BLOCK_TOKENS`` tokens or ``BLOCK_DOCS`` documents; so
no source of any share of the rows is in one task. What a document needs to know is one row for each source.

The bisection evaluates ``2**STEP`` exponents at a time, each a sum over sources, so sources may be many; the broadcast of
the sources' table is by its counted rows, and beyond the limit large sources alone are broadcast.

Defined results: null text has no tokens and a document without tokens is used as often as its source's full epochs; null
sources are one source; with one source, or all sources alike, any exponent gives the same weights; repeated rows are
numbered and each of them is a document of its own in the order; an empty table gives no rows; further columns are kept by
``mix``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlane.llm.blocks import join_hot
from arborlane.session import broadcast_if_small, materialise

WORD = r"[^\x20\x09-\x0D]+"
STEP, ROUNDS = 6, 6
BLOCK_TOKENS, BLOCK_DOCS, CELLS = 1 << 20, 1 << 16, 1024


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the greatest entropy to reach. ``repeats``: epochs of the most repeated source, all whole."""

    entropy: float | None = None
    repeats: float | None = None


def _exponent(shares: DataFrame, sources: int, target: Target) -> float:
    """The largest exponent in [0, 1] that meets the target; shares: (ln_p)."""

    def met(alphas: list[float]) -> list[bool]:
        each = shares.select("ln_p", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
        z, a = F.exp(F.col("alpha") * F.col("ln_p")), F.col("alpha")
        row = each.groupBy("alpha").agg(
            F.sum(z).alias("z"), F.sum(z * a * F.col("ln_p")).alias("zl"),
            F.max((a - 1) * F.col("ln_p")).alias("most"), F.min((a - 1) * F.col("ln_p")).alias("least"),
        )
        found = {r["alpha"]: r for r in row.collect()}  # 2**STEP rows
        out = []
        for x in alphas:
            r = found[x]
            entropy = math.log(r["z"]) - r["zl"] / r["z"]
            repeats = math.exp(r["most"] - r["least"])
            by_entropy = target.entropy is None or entropy >= target.entropy * math.log(max(sources, 1)) - 1e-12
            # More repetition comes with smaller exponents: the limit is met from some exponent upwards.
            out.append(by_entropy if target.repeats is None else repeats <= target.repeats + 1e-12)
        return out

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / 2**STEP for i in range(2**STEP + 1)]
        good = met(grid)
        if target.repeats is not None:  # smallest exponent within the limit
            if good[0]:
                return grid[0]
            i = next((i for i, g in enumerate(good) if g), len(grid) - 1)
            low, high = grid[max(i - 1, 0)], grid[i]
        else:  # largest exponent with enough entropy
            if good[-1]:
                return grid[-1]
            i = max((i for i, g in enumerate(good) if g), default=0)
            low, high = grid[i], grid[min(i + 1, len(grid) - 1)]
    return high if target.repeats is not None else low


def _order(epoch: Column, *of: Column) -> Column:
    return F.xxhash64(epoch.cast("long"), *of)


def _cell(order: Column) -> Column:
    """One of CELLS cells, ascending with the order."""
    return F.shiftright(order, 64 - CELLS.bit_length() + 1)


def _source(of: Column) -> Column:
    return F.when(of.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), of.cast("string")))


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(row: Column, text: Column) -> Column:
    return F.xxhash64(row, text.cast("string"))


def _numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows (k, row, ..) with ``unit``: k, and a hash of k and its number for the further rows of one key.

    again: (k, n) of the keys that several rows have. Rows of a key are numbered within partitions, then by partition.
    """
    if again is None:
        return rows.withColumn("unit", F.col("k"))
    total = rows.count()
    plain = join_hot(rows, again, "k", "n", total, "left_anti").withColumn("unit", F.col("k"))
    some = join_hot(rows, again, "k", "n", total).withColumn("part", F.shiftrightunsigned("row", 33))
    by = some.groupBy("k", "part").agg(F.count("*").alias("rows"))
    shift = by.select("k", "part", (F.sum("rows").over(Window.partitionBy("k").orderBy("part")) - F.col("rows")).alias("shift"))
    place = F.row_number().over(Window.partitionBy("k", "part").orderBy("row"))
    number = F.col("shift") + F.col("place") - 1
    unit = F.when(number == 0, F.col("k")).otherwise(F.xxhash64("k", number.cast("long")))
    some = some.withColumn("place", place).join(shift, ["k", "part"]).withColumn("unit", unit)
    return materialise(plain.unionByName(some.select(plain.columns)), "units")


def _running(blocks: DataFrame, by: list[str], of: str, name: str) -> DataFrame:
    """blocks (by .., block, order) with the sum of ``of`` over the blocks before each in its order, cell by cell."""
    celled = blocks.withColumn("cell", _cell(F.col("order")))
    sums = celled.groupBy(*by, "cell").agg(F.sum(of).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*by).orderBy("cell")) - F.col("sum")
    inside = F.sum(of).over(Window.partitionBy(*by, "cell").orderBy("order", "block")) - F.col(of)
    celled = celled.withColumn(name, inside).join(sums.select(*by, "cell", before.alias("cell_before")), [*by, "cell"])
    return celled.withColumn(name, F.col(name) + F.col("cell_before")).drop("cell", "cell_before")


@dataclass
class Plan:
    """sources: of each tokens, share, weight, budget, epochs, and where the partial epoch ends. rows: how many there are."""

    sources: DataFrame
    count: int
    rows: int
    again: DataFrame | None

    def joined(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with columns of their source."""
        mine = self.sources.select("source", "docs", *columns)
        if self.count <= SOURCES:
            return rows.join(broadcast_if_small(mine.drop("docs"), self.count, SOURCES), "source")
        return join_hot(rows, mine, "source", "docs", self.rows)


#: How many sources may be sent to all tasks.
SOURCES = 100_000


def _weighted(totals: DataFrame, target: Target, budget: int | None) -> tuple[DataFrame, int]:
    """totals (source, n, docs): with share, weight, budget, epochs, rest of the partial epoch, blocks. And their number."""
    count, all_tokens = totals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    some = totals.filter("n > 0").withColumn("ln_p", F.log(F.col("n") / F.lit(float(max(all_tokens, 1)))))
    alpha = _exponent(some.select("ln_p"), some.count(), target) if all_tokens else 1.0
    z, least = some.agg(F.sum(F.exp(alpha * F.col("ln_p"))), F.max((1 - alpha) * F.col("ln_p"))).first() if all_tokens else (1.0, 0.0)
    total = budget if budget is not None else all_tokens * z * math.exp(least)
    weighted = totals.withColumn("share", F.col("n") / F.lit(float(max(all_tokens, 1)))).withColumn(
        "weight", F.when(F.col("n") > 0, F.exp(alpha * F.log("share")) / F.lit(z)).otherwise(F.lit(0.0))
    )
    # A rounding error must not cut a source that the budget holds whole.
    wanted = F.when(F.col("n") > 0, F.floor(F.col("weight") * F.lit(float(total)) + F.lit(1e-6) * F.col("n"))).otherwise(0)
    weighted = weighted.withColumns({"alpha": F.lit(alpha), "budget": wanted.cast("long")})
    weighted = weighted.withColumn("epochs", F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1).cast("long"))
    weighted = weighted.withColumn("rest", F.when(F.col("n") > 0, F.col("budget") - F.col("epochs") * F.col("n")).otherwise(0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK_TOKENS)), F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)))
    return weighted.withColumn("blocks", blocks.cast("long")), count


def plan(rows: DataFrame, target: Target, budget: int | None = None) -> tuple[DataFrame, Plan]:
    """rows: a written table (source, tokens, k, row, ..). (rows with their unit, the plan).

    ``budget`` tokens in all; None: the least at which no source is cut.
    """
    again = materialise(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    again = again if again.limit(1).count() else None
    units = _numbered(rows, again)
    totals = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")), "sources")
    weighted, count = _weighted(totals, target, budget)
    found = Plan(materialise(weighted, "weights"), count, rows.count(), again)
    # The partial epoch: blocks in order, then the documents of the one block of each source where the budget ends.
    placed = found.joined(units, "epochs", "rest", "blocks").filter("rest > 0").withColumn("block", _block())
    by_block = placed.groupBy("source", "block", "epochs", "rest").agg(F.sum("tokens").alias("tokens"))
    by_block = by_block.withColumn("order", _order(F.col("epochs"), F.col("source"), F.col("block")))
    running = _running(materialise(by_block, "blocks"), ["source"], "tokens", "before")
    ends = running.filter("before <= rest and before + tokens > rest")
    ends = materialise(ends.select("source", "block", F.col("order").alias("end_order"), (F.col("rest") - F.col("before")).alias("room")), "ends")
    inside = placed.join(broadcast_if_small(ends, count, SOURCES), ["source", "block"]).withColumn("order", _order(F.col("epochs"), F.col("unit")))
    within = Window.partitionBy("source", "block").orderBy("order", "unit")
    inside = inside.withColumn("reached", F.sum("tokens").over(within)).filter("reached <= room")
    cut = inside.groupBy("source").agg(F.max(F.struct("order", "unit")).alias("last"))
    sources = found.sources.join(ends.select("source", F.col("block").alias("end_block"), "end_order"), "source", "left").join(cut, "source", "left")
    found.sources = materialise(sources, "mix")
    return units, found


def _block() -> Column:
    return F.pmod(F.xxhash64("unit", F.lit(1)), F.col("blocks"))


PLACE = ("epochs", "rest", "blocks", "end_block", "end_order", "last")


def _uses() -> Column:
    """How often a document is used: full epochs, and once more if the partial epoch reaches it."""
    order, block = _order(F.col("epochs"), F.col("source"), _block()), _block()
    before = (order < F.col("end_order")) | ((order == F.col("end_order")) & (block < F.col("end_block")))
    last = (block == F.col("end_block")) & (F.struct(_order(F.col("epochs"), F.col("unit")).alias("order"), F.col("unit")) <= F.col("last"))
    partial = (F.col("rest") > 0) & (F.col("end_order").isNull() | before | F.coalesce(last, F.lit(False)))
    return F.col("epochs") + F.when(partial, 1).otherwise(0)


def usage(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None) -> DataFrame:
    """A row for each use of each input row, and one with a null epoch for a row that is not used.

    id, source, n_tokens, uses (of the row in all), epoch, block (its place among the epoch's blocks of the source), position
    (in the block), and of the source share, weight and budget.
    """
    of = {c: F.col(f"`{c}`") for c in (id_col, text_col, source_col)}
    rows = docs.select(
        of[id_col].alias("id"), of[source_col].alias("named"), _source(of[source_col]).alias("source"), _tokens(of[text_col]).alias("tokens"),
        _key(of[id_col], of[text_col]).alias("k"), F.monotonically_increasing_id().alias("row"),
    )
    units, found = plan(materialise(rows, "tokens"), target, budget)
    used = found.joined(units, *PLACE, "share", "weight", "budget").withColumns({"uses": _uses().cast("long"), "block": _block()})
    used = materialise(used.drop(*PLACE, "k", "row"), "uses")
    each = used.filter("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    by = ["source", "epoch"]
    blocks = each.groupBy(*by, "block").agg(F.lit(1).alias("one")).withColumn("order", _order(F.col("epoch"), F.col("source"), F.col("block")))
    ranked = _running(materialise(blocks, "blocks"), by, "one", "rank").select(*by, "block", "rank")
    place = F.row_number().over(Window.partitionBy(*by, "block").orderBy(_order(F.col("epoch"), F.col("unit")), "unit"))
    each = each.withColumn("position", place.cast("long") - 1).join(ranked, [*by, "block"]).withColumn("block", F.col("rank").cast("long"))
    none = used.filter("uses = 0").withColumns({c: F.lit(None).cast("long") for c in ("block", "epoch", "position")})
    out = ["id", "named", "tokens", "uses", "epoch", "block", "position", "share", "weight", "budget"]
    return each.select(out).unionByName(none.select(out)).withColumnsRenamed({"id": id_col, "named": "source", "tokens": "n_tokens"})


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None) -> DataFrame:
    """The rows as often as they are used, with all their columns; they stay where they are, so the uses' order is that of
    ``usage`` and not of the rows. Texts are not shuffled, but for those of repeated rows."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    row, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    keyed = plain.withColumns({"k": _key(row, text), "source": _source(source), "row": F.monotonically_increasing_id()})
    _, found = plan(materialise(keyed.select("source", _tokens(text).alias("tokens"), "k", "row"), "tokens"), target, budget)
    if found.again is None:
        units = keyed.withColumn("unit", F.col("k"))
    else:  # repeated rows are written, so that their numbers are fixed; they are alike, so any order of them will do
        some = materialise(join_hot(keyed, found.again, "k", "n", found.rows), "repeated")
        units = join_hot(keyed, found.again, "k", "n", found.rows, "left_anti").withColumn("unit", F.col("k"))
        units = units.unionByName(_numbered(some, found.again).select(units.columns))
    uses = found.joined(units, *PLACE).withColumn("uses", _uses().cast("int")).filter("uses > 0")
    copies = uses.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    return copies.select(*plain.columns).toDF(*names)
