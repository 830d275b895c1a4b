"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is its words, each weighted by how often it occurs. For sample j and word x a hash of both draws r and c from
Gamma(2, 1) and b from [0, 1); with weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The sample is the
pair (x, t) of least a. Two documents agree in a sample with the probability of their generalised Jaccard similarity, the
sum of least weights over the sum of greatest. A fingerprint is ``SAMPLES`` samples of 16 bits, four hex digits each, so
unequal samples agree by chance once in 65,535 times.

The least a is exponential with the text's total weight, its number of words, as the rate, so draws whose a is certainly
over ``CERTAIN`` over that weight are left out at first. A fingerprint with a sample whose least a is not under that bound
is worked out anew with every draw; so each fingerprint is that of all draws and depends on the text's words alone.

A draw from Gamma(2, 1) is minus the log of a product of two uniform numbers. Words are counted and sampled where their
document lies: after one exchange of the texts by document nothing is shuffled but neighbours' beginnings and, at the
end, the fingerprints. Every document is small against a partition, so no key is hot.

Defined results: null text counts as empty; a text without words has all-zero samples and is like another without words
(1.0) and like none with words; rows repeated whole count as one document in the order and each get its row; documents of
equal id are ordered by a hash of the text, a null id comes first; a single document is its own next one; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlane.session import broadcast_if_small, materialise, release, tasks_for

SAMPLES, GROUP = 64, 4
BITS = 21
#: A sample's least a is under CERTAIN over the number of words but once in exp(CERTAIN), about nine million.
CERTAIN = 16.0
#: Keys to try before giving up; each tells all of 1e10 documents apart with a chance of about a tenth at worst.
KEYS = 64
BLANK = r"[\x20\x09-\x0D]+"


def _uniform(h: Column, part: int) -> Column:
    """A third of a hash as a number inside (0, 1)."""
    bits = F.shiftrightunsigned(h, BITS * part).bitwiseAND(F.lit((1 << BITS) - 1))
    return (bits + F.lit(0.5)) * F.lit(1.0 / (1 << BITS))


def _key(ln_a: Column) -> Column:
    return ((ln_a + F.lit(256.0)) * F.lit(float(1 << 26))).cast("bigint")


def _samples_of_group(weighted: DataFrame, key: str, certain: float | None) -> DataFrame:
    """(key, g, a0.., b0.., exact): the least of each of GROUP samples over a document's terms, for both texts.

    Every term meets every group of samples, so that a row works out few samples in small generated code. A text's bound
    is ``certain`` over its number of words, n0 or n1. Where a term's a is certainly over the bounds of both texts its
    draws stay null: a >= c exp(-r) / w >= (1 - v1 v2) u1 u2 / w, without logarithms, where r and c are -ln(u1 u2) and
    -ln(v1 v2). exact: whether the least a of every sample is under its text's bound, so that no term left out is less.
    Without ``certain`` no draw is left out.
    """
    some_words = [F.greatest(n, F.lit(1)) for n in ("n0", "n1")]
    bound = F.greatest(*(F.lit(certain) * F.col(w) / n for w, n in zip(("w0", "w1"), some_words, strict=True))) if certain else None
    weighted = weighted.withColumn("bound", bound) if certain else weighted
    seed = F.col("g") * F.lit(2 * GROUP)
    cols = []
    for j in range(GROUP):
        h, g = F.xxhash64("term", seed + F.lit(2 * j)), F.xxhash64("term", seed + F.lit(2 * j + 1))
        u, v = _uniform(h, 0) * _uniform(h, 1), _uniform(g, 0) * _uniform(g, 1)
        near = (F.lit(1.0) - v) * u < F.col("bound") if certain else F.lit(True)
        cols += [F.when(near, -F.log(u)).alias(f"r{j}"), F.when(near, F.log(-F.log(v))).alias(f"c{j}"), _uniform(h, 2).alias(f"u{j}"), F.shiftrightunsigned(g, 2 * BITS).alias(f"x{j}")]
    drawn = weighted.select(key, "n0", "n1", "g", "w0", "w1", "ln_w0", "ln_w1", *cols)
    low = F.lit((1 << 20) - 1)

    def sample(j: int, w: str) -> Column:
        r, ln_c, b, word = (F.col(f"{c}{j}") for c in "rcux")
        t = F.when(F.col(w) > 1, F.floor(F.col(f"ln_{w}") / r + b)).otherwise(F.lit(0))
        ln_a = ln_c - r * (t - b + F.lit(1.0))
        drawn_a = F.shiftleft(_key(ln_a), 20).bitwiseOR((word + t * F.lit(40503)).bitwiseAND(low))
        return F.when(F.col(w) > 0, F.coalesce(drawn_a, F.lit(1 << 61)))

    least = drawn.groupBy(key, "n0", "n1", "g").agg(*(F.min(sample(j, w)).alias(f"{n}{j}") for n, w in (("a", "w0"), ("b", "w1")) for j in range(GROUP)))
    if not certain:
        return least.withColumn("exact", F.lit(True))
    # One step less than the bound's own, against rounding.
    limits = [F.shiftleft(_key(F.log(F.lit(certain) / n)) - F.lit(1), 20) for n in some_words]
    worst = [F.greatest(*(F.coalesce(F.col(f"{c}{j}"), F.lit(0)) for j in range(GROUP))) for c in "ab"]
    return least.withColumn("exact", (worst[0] < limits[0]) & (worst[1] < limits[1]))


def _hex(least: str) -> Column:
    sample = F.pmod(F.col(least).bitwiseAND(F.lit((1 << 20) - 1)), F.lit(65535)) + F.lit(1)
    return F.coalesce(F.lpad(F.lower(F.hex(sample)), 4, "0"), F.lit("0000"))


def likeness(x: Column, y: Column, count: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(x, 4 * j + 1, 4) == F.substring(y, 4 * j + 1, 4), F.lit(1)).otherwise(F.lit(0)) for j in range(count)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(count))


def fingerprint_pair(texts: DataFrame, key: str, first: str, second: str, count: int = SAMPLES, certain: float | None = None) -> DataFrame:
    """(key, fingerprint, second_fingerprint, exact) of two texts of each row; rows must already lie by key."""
    blank = [F.split(t, BLANK) for t in (first, second)]
    split = texts.select(key, blank[0].alias("x0"), blank[1].alias("x1"))

    def number(x: str) -> Column:
        """Words of a split text, whose first and last piece alone can be empty."""
        ends = [F.when(F.element_at(x, at) == "", 1).otherwise(0) for at in (1, -1)]
        return F.greatest(F.size(x) - ends[0] - ends[1], F.lit(0))

    each = F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"x{w}").alias("x")) for w in (0, 1)))
    both = split.select(key, number("x0").alias("n0"), number("x1").alias("n1"), F.explode(each).alias("s"))
    words = both.select(key, "n0", "n1", F.col("s.w").alias("w"), F.explode("s.x").alias("x"))
    term = F.when(F.col("x") != "", F.xxhash64("x"))
    counted = words.groupBy(key, "n0", "n1", term.alias("term")).agg(
        F.sum(F.when(F.col("w") == 0, 1).otherwise(0)).alias("w0"), F.sum(F.col("w")).alias("w1")
    )
    some = F.col("term").isNotNull()
    w0, w1 = (F.when(some, F.col(w)).otherwise(0) for w in ("w0", "w1"))
    weighted = counted.select(
        key, "n0", "n1", "term", w0.alias("w0"), w1.alias("w1"), F.log(F.col("w0").cast("double")).alias("ln_w0"), F.log(F.col("w1").cast("double")).alias("ln_w1"),
        F.explode(F.array(*map(F.lit, range(count // GROUP)))).alias("g"),
    )
    least = _samples_of_group(weighted, key, certain)
    parts = F.struct("g", F.concat(*(_hex(f"a{j}") for j in range(GROUP))).alias("a"), F.concat(*(_hex(f"b{j}") for j in range(GROUP))).alias("b"))
    joined = least.select(key, "exact", parts.alias("p")).groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("p"), F.min("exact").alias("exact"))
    return joined.select(key, F.array_join(F.col("p.a"), "").alias("fingerprint"), F.array_join(F.col("p.b"), "").alias("second_fingerprint"), "exact")


def _order(meta: DataFrame) -> DataFrame:
    """(k, id, next_k, n) in the order of id and k, the last row's next the first's; no window over more than a partition."""
    spark = meta.sparkSession
    dealt = meta.repartitionByRange(tasks_for(spark), "id", "k").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "order")
    lead = F.lead("k").over(Window.partitionBy("part").orderBy("id", "k"))
    inner = dealt.withColumn("next_k", lead)
    # One row for each partition.
    firsts = inner.groupBy("part").agg(F.min(F.struct("id", "k")).getField("k").alias("k")).collect()
    firsts = [r["k"] for r in sorted(firsts, key=lambda r: r["part"])]
    parts = [r["part"] for r in inner.select("part").distinct().orderBy("part").collect()]
    follow = {p: firsts[(i + 1) % len(firsts)] for i, p in enumerate(parts)}
    rows = spark.createDataFrame(list(follow.items()) or [(-1, 0)], "part int, follow long")
    return inner.join(F.broadcast(rows), "part").select("k", "id", F.coalesce("next_k", "follow").alias("next_k"), "n")


def _found(base: DataFrame, order: DataFrame, count: int, certain: float | None) -> DataFrame:
    """(k, id, next_k, n_chars, edited_sha256, fingerprint, second_fingerprint, exact) of every document of ``order``."""
    # Who asks a document for its beginning, and how much of it.
    asks = order.select(F.col("next_k").alias("k"), F.col("k").alias("by"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    texts = base.select("k", "text").repartition(4 * tasks_for(base.sparkSession), "k")
    heads = texts.join(asks.hint("shuffle_hash"), "k").select(F.col("by").alias("k"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    size = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (size - F.floor(size / 4)).cast("int")), F.col("head"))
    pairs = texts.join(heads.hint("shuffle_hash"), "k").select("k", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # Both sides read the same columns of the same exchanges, so Spark shuffles the texts once.
    about = pairs.select("k", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    about = about.join(order.select("k", "id", "next_k").hint("shuffle_hash"), "k")
    return fingerprint_pair(pairs, "k", "text", "edited", count, certain).join(about.hint("shuffle_hash"), "k")


def _meta(base: DataFrame, seed: int) -> tuple[DataFrame, bool, bool]:
    """(k, id, n, rows) of every document, whether one is repeated, and whether unlike ones share a key.

    A key stands for one document only if all its rows agree in a second hash; else the caller takes other keys.
    """
    second = F.xxhash64("text", "id", F.lit(~seed))
    keyed = base.select("k", "id", F.length("text").alias("n"), second.alias("second")).groupBy("k")
    meta = keyed.agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("rows"), (F.min("second") != F.max("second")).alias("clash"))
    meta = materialise(meta, "meta")
    repeated, clash = meta.agg(F.coalesce(F.max("rows"), F.lit(0)) > 1, F.coalesce(F.bool_or("clash"), F.lit(False))).first()
    return meta, repeated, clash


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SAMPLES) -> DataFrame:
    """One row for each input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    for seed in range(KEYS):
        base = plain.withColumn("k", F.xxhash64(F.lit(seed), "id", "text"))
        meta, repeated, clash = _meta(base, seed)
        if not clash:
            break
        release(meta)
    else:
        raise RuntimeError("no key tells all documents apart")
    if repeated:
        base = base.groupBy("k").agg(F.first("id").alias("id"), F.first("text").alias("text"))  # of one key all are alike
    order = _order(meta.select("k", "id", "n"))
    found = materialise(_found(base, order, count, CERTAIN), "found")
    inexact = materialise(found.filter(~F.col("exact")).select("k", "next_k"), "inexact")
    number = inexact.count()
    if number:
        # Few: sent to the texts, which are then not shuffled to find those that are worked out anew.
        asking = broadcast_if_small(inexact.select("k"), number)
        needed = broadcast_if_small(inexact.select(F.explode(F.array("k", "next_k")).alias("k")).distinct(), 2 * number)
        redone = _found(base.join(needed, "k", "left_semi"), order.join(asking, "k", "left_semi"), count, None)
        found = found.filter("exact").unionByName(redone)
    # A row goes to its own key with its fingerprint, and to the next document's with all it has, to meet the other there.
    out = [F.col(c) for c in ("id", "n_chars", "edited_sha256", "fingerprint", "second_fingerprint")]
    sent = found.select(
        F.explode(
            F.array(
                F.struct(F.col("k").alias("at"), F.lit(None).cast("bigint").alias("k"), *(F.lit(None).cast(found.schema[c._jc.toString()].dataType).alias(c._jc.toString()) for c in out[:3]), F.col("fingerprint"), F.lit(None).cast("string").alias("second_fingerprint")),
                F.struct(F.col("next_k").alias("at"), F.col("k"), *out),
            )
        ).alias("r")
    ).select("r.*")
    met = sent.groupBy("at").agg(
        F.max(F.when(F.col("k").isNull(), F.col("fingerprint"))).alias("next_fingerprint"),
        F.max(F.when(F.col("k").isNotNull(), F.struct("k", *(c._jc.toString() for c in out)))).alias("r"),
    ).select("r.*", "next_fingerprint")
    if repeated:
        met = met.join(meta.select("k", "rows"), "k").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return met.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", F.col("second_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("second_fingerprint"), count).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), count).alias("near_next"),
    )
