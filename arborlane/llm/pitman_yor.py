"""LM scoring with a hierarchical Pitman-Yor model.

Every context, the 64-bit hash of the previous word, is a restaurant; all share one parent, the unigram restaurant, whose
base is uniform over the training words and one unknown. A context's customers are the training tokens after it, and each of
its tables sends a customer to the parent. In a sweep the customers of every dish (a word in a context) leave and are seated
again one by one, at a new table with weight (strength + discount * tables of the restaurant) * parent's probability, else at
an old one with (customers - discount * tables of the dish); then the parent's customers of every word are, likewise. Other
dishes stand as the sweep before left them: all restaurants sit down at once, and every total is brought up to date between
sweeps. Predictive probabilities are averaged over the sweeps after ``BURN``.

Seating is exact for dishes of any size: the first ``SINGLY`` customers draw in turn; from there, for ``LEAPS`` tables, the
number of the next customer who opens one is drawn, by inverting the probability that none has yet; the customers of dishes
with yet more tables draw for themselves again, many at a time, until all that they decided agrees with those before them.
Draws are hashes of sweep, context, word and place, so the result does not depend on how the words are dealt.

Plan: pairs of word and context are counted in runs of tokens and dealt by word, as sorted, packed blocks, so that all dishes
of a word and its parent's tables meet in one task. What sweeps need is written: the dishes of several customers (one customer has one table), and the words. Tables by
context are added up in tasks that contexts are dealt to and sent back in the order they were asked for, by way of Spark and
not the driver, which gets sums of fixed size. At the end tokens are dealt likewise and scored where their word's dishes are; sums
go back for those documents that have a token there, so a token sends one entry at most.

Skew: words that make up more than ``HOT_SHARE`` of a run of tokens (a bounded number) are counted first and dealt by word
and context, so that a word of any share is in all tasks; their counts, and the parent's customers and tables of them, are
sent to the tasks.

Defined results: null text counts as empty, one end token; a word is new if no training document has it; a null id is in
training; repeated rows are read and scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arborlane.llm.blocks import batch, binary
from arborlane.llm.words import MIX_A, Words, chunks, mix, tidy
from arborlane.session import collect_shuffles, materialise, release

HOT_SHARE, HOT_WORDS = 1 / 128, 1024
RUN_TOKENS, BUCKET_CHARS = 1_500_000, 24_000_000
SUMS = 4
STRENGTH = 1.0
BURN, SAMPLES = 1, 2
SINGLY, LEAPS, MANY = 16, 24, 1 << 16
END = np.uint64(0x8F5C28F5C28F5C29)  # stands for the end of a document


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, text) of every word and every end of a chunk of texts."""
    words = Words(data, offsets, fold=True)
    texts = len(offsets) - 1
    token = np.empty(len(words) + texts, np.uint64)
    token[np.arange(len(words)) + words.doc] = words.hashes()
    ends = words.first[1:] + np.arange(texts)
    token[ends] = END
    doc = np.repeat(np.arange(texts), words.counts() + 1)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.append(0, ends[:-1] + 1)[: min(texts, len(token))]] = END
    return token, before, doc


def _runs(batches: Iterator[pa.RecordBatch]):
    """(ids, held out, tokens, contexts, document of each token) of runs of about RUN_TOKENS tokens."""
    ids, held, parts, docs, tokens = [], [], [], 0, 0
    for rows in batches:
        flags = rows.column("held_out").to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(rows.column("text")):
            token, context, doc = token_stream(data, offsets)
            n = len(offsets) - 1
            ids.append(rows.column("id").slice(first, n))
            held.append(flags[first : first + n])
            parts.append((token, context, doc + docs))
            docs, tokens = docs + n, tokens + len(token)
            if tokens >= RUN_TOKENS:
                yield pa.concat_arrays(ids), np.concatenate(held), *(np.concatenate(x) for x in zip(*parts, strict=True))
                ids, held, parts, docs, tokens = [], [], [], 0, 0
    if parts:
        yield pa.concat_arrays(ids), np.concatenate(held), *(np.concatenate(x) for x in zip(*parts, strict=True))


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, token, _, _ in _runs(batches):
        word, n = np.unique(token, return_counts=True)
        many = n > max(len(token), RUN_TOKENS / 10) * HOT_SHARE
        yield batch(word=pa.array(word[many].view(np.int64)), n=pa.array(n[many].astype(np.int64)))


def _hot_counts(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot), np.int64)
        for _, held, token, _, doc in _runs(batches):
            token = token[~held[doc]]
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            total += np.bincount(at[hot[at] == token], minlength=len(hot))
        yield batch(word=pa.array(hot.view(np.int64)), n=pa.array(total))

    return run


#: One shape for all packed rows: what a row is, the task it goes to, a number, and arrays.
ARRAYS = ("a", "b", "c", "d", "e", "f")
PACKED = "kind string, bucket int, run long, x double, " + ", ".join(f"{c} binary" for c in ARRAYS)


def packed(kind: str, bucket: int, run: int = 0, x: float = 0.0, **arrays: np.ndarray) -> pa.RecordBatch:
    given = {c: pa.array([binary(arrays[c])] if c in arrays else [None], pa.binary()) for c in ARRAYS}
    return batch(kind=pa.array([kind]), bucket=pa.array([bucket], pa.int32()), run=pa.array([run], pa.int64()), x=pa.array([x], pa.float64()), **given)


def _ints(x: np.ndarray) -> np.ndarray:
    """In as few bytes as hold the greatest; the first byte of eight says how many."""
    x = np.asarray(x)
    most = int(x.max()) if len(x) else 0
    size = next(k for k in (1, 2, 4, 8) if most < 1 << 8 * k or k == 8)
    return np.concatenate([np.frombuffer(size.to_bytes(8, "little"), np.uint8), np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8)])


def _read_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=8).astype(np.int64)


def _bucket(token: np.ndarray, context: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Where a token goes: by word, and by word and context if the word is hot."""
    key = mix(token)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
        key = np.where(hot[at] == token, mix(key + context), key)
    return ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)


def _home(run: int, buckets: int) -> int:
    """Where a run's documents get their sums."""
    return int(mix(np.array([run], np.uint64))[0] % np.uint64(buckets))


def _deal_pairs(hot: np.ndarray, buckets: int):
    """Row ``pairs`` of each bucket and run: its pairs of word and context with how often they are in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, token, context, doc in _runs(batches):
            to = _bucket(token, context, hot, buckets)
            order = np.lexsort((context, token, to))
            token, context, to, train = token[order], context[order], to[order], ~held[doc[order]]
            first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (context[1:] != context[:-1]) | (to[1:] != to[:-1]))[: len(token)])
            if not len(first):
                continue
            count = np.add.reduceat(train.astype(np.int64), first)
            token, context, to = token[first], context[first], to[first]
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for lo, hi in zip(cuts, cuts[1:]):
                new = np.flatnonzero(np.append(True, token[lo + 1 : hi] != token[lo : hi - 1]))
                known, at = np.unique(context[lo:hi], return_inverse=True)
                yield packed("pairs", int(to[lo]), a=token[lo:hi][new], b=_ints(np.diff(np.append(new, hi - lo))), c=known, d=_ints(at), e=_ints(count[lo:hi]))

    return run


def _deal(hot: np.ndarray, buckets: int, ids_type: pa.DataType):
    """Runs of tokens, dealt by word: row ``tokens`` of each bucket, and row ``head`` of the run's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, held, token, context, doc) in enumerate(_runs(batches)):
            name = part << 24 | number
            length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
            no_ids = pa.nulls(1, pa.list_(ids_type))
            head = packed("head", _home(name, buckets), name, a=held.astype(np.uint8), b=_ints(length))
            yield head.append_column("ids", pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            to = _bucket(token, context, hot, buckets)
            order = np.argsort(token, kind="stable")
            order = order[np.argsort(to[order], kind="stable")]
            token, context, doc, to = token[order], context[order], doc[order], to[order]
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for lo, hi in zip(cuts, cuts[1:]):
                first = np.flatnonzero(np.append(True, token[lo + 1 : hi] != token[lo : hi - 1]))
                known, at = np.unique(context[lo:hi], return_inverse=True)
                mine = doc[lo:hi]
                yield packed(
                    "tokens", int(to[lo]), name, a=token[lo:hi][first], b=_ints(np.diff(np.append(first, hi - lo))), c=known, d=_ints(at), e=_ints(mine),
                    f=np.packbits(held[mine]),
                ).append_column("ids", no_ids)

    return run


@dataclass
class Totals:
    """Of the state after a sweep: the parent's customers and tables in all, and of each hot word."""

    tokens: float  # of training
    words: float  # distinct
    discount: float
    root_discount: float
    hot: np.ndarray
    root_customers: float = 0.0
    root_tables: float = 0.0
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of_words(self, words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parent's customers and tables of the words of a part, whole also for hot words."""
        if not len(self.hot) or not len(words):
            return customers, tables
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        shared = self.hot[at] == words
        return np.where(shared, self.hot_customers[at], customers), np.where(shared, self.hot_tables[at], tables)

    def parent(self, customers, tables, gone=0.0):
        """The parent's probability of words; gone: customers that left."""
        customers = customers - gone
        base = (STRENGTH + self.root_discount * self.root_tables) / (self.words + 1)
        return (np.maximum(customers - self.root_discount * np.minimum(tables, customers), 0) + base) / (STRENGTH + self.root_customers - gone)

    def seat_root(self, customers: np.ndarray, old: np.ndarray, words: np.ndarray, sweep: int, seed: int) -> np.ndarray:
        base, slope = 1 / (self.words + 1), self.root_discount / (self.words + 1)
        weight = (STRENGTH + self.root_discount * (self.root_tables - old)) * base
        return seat(customers, weight, slope, self.root_discount, mix(words ^ _salt(seed, sweep, 1)))


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


def _salt(seed: int, sweep: int, level: int) -> np.uint64:
    return mix(np.array([(seed * 1000 + sweep) * 2 + level + 1], np.uint64))[0]


def _draw(key: np.ndarray, place) -> np.ndarray:
    """A number in (0, 1) for each key and place."""
    bits = mix(key + np.atleast_1d(np.asarray(place, np.uint64)) * MIX_A)
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0, by Stirling's series eight further up."""
    step = x.copy()
    for k in range(1, 8):
        step = step * (x + k)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(step)


def seat(customers: np.ndarray, weight: np.ndarray, slope, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one. With t tables a new one has weight + slope * t.

    key: 64-bit hashes, one for each dish, that the draws come from.
    """
    tables = np.minimum(customers, 1).astype(float)
    weight, slope = (np.broadcast_to(np.asarray(x, float), tables.shape) for x in (weight, slope))
    active = np.flatnonzero(customers > 1)
    for seated in range(1, SINGLY):
        if not len(active):
            return tables
        t = tables[active]
        new = weight[active] + slope[active] * t
        tables[active] = t + (_draw(key[active], seated) < new / (new + seated - discount * t))
        active = active[customers[active] > seated + 1]
    n, places = np.full(len(active), float(SINGLY)), np.atleast_1d(key)
    leaps = 0
    while len(active) and leaps < LEAPS:
        leaps += 1
        t, c = tables[active], customers[active].astype(float)
        new = weight[active] + slope[active] * t
        # Nobody opens a table from customer n + 1 to m with probability exp(fall(m) - fall(n)).
        fall = lambda m, at=slice(None): _lgamma(m - discount * t[at]) - _lgamma(m - discount * t[at] + new[at])  # noqa: B023, E731
        limit = np.log(_draw(key[active], SINGLY + t.astype(np.int64))) + fall(n)
        opens = fall(c) <= limit
        active, n, c, t, new, limit = active[opens], n[opens], c[opens], t[opens], new[opens], limit[opens]
        low, high = n.copy(), c.copy()  # the first m whose fall is at most the limit is in (low, high]
        wide = np.flatnonzero(high - low > 1)
        while len(wide):
            middle = np.floor((low[wide] + high[wide]) / 2)
            under = fall(middle, wide) <= limit[wide]
            high[wide] = np.where(under, middle, high[wide])
            low[wide] = np.where(under, low[wide], middle)
            wide = wide[high[wide] - low[wide] > 1]
        tables[active] = t + 1
        more = high < c
        active, n = active[more], high[more]
    for i, seated in zip(active.tolist(), n.astype(np.int64).tolist()):
        tables[i] = _seat_many(int(customers[i]), seated, tables[i], weight[i], slope[i], discount, places[i : i + 1])
    return tables


def _seat_many(customers: int, seated: int, tables: float, weight: float, slope: float, discount: float, key: np.ndarray) -> float:
    """Tables of one dish whose further customers draw one by one, ``MANY`` worked out at a time.

    A customer's decision depends on how many tables are opened before, so decisions are worked out again from one another
    until they agree; each time at least one more customer's is final, and tables only grow in number.
    """
    for at in range(seated, customers, MANY):
        before = np.arange(at, min(at + MANY, customers))
        draw = _draw(key, before + (1 << 40))
        opens, t = None, np.full(len(before), tables)
        while True:
            new = weight + slope * t
            now = draw * (new + before - discount * t) < new
            if opens is not None and np.array_equal(now, opens):
                break
            opens = now
            t = tables + np.cumsum(opens) - opens
        tables += float(opens.sum())
    return tables


class _Part:
    """The tokens, or pairs, of one bucket. Dishes are in the order of words and contexts, whatever order the rows come in."""

    def __init__(self, rows: list[dict]):
        words, counts, known, contexts, self.doc, train, self.runs, at = [], [], [], [], [], [], [], 0
        pairs_given = rows[0]["kind"] == "pairs"
        for r in rows:
            doc = _read_ints(r["e"])  # of pairs: how often they are in training
            words.append(np.frombuffer(r["a"], np.uint64))
            counts.append(_read_ints(r["b"]))
            known.append(np.frombuffer(r["c"], np.uint64))
            contexts.append(_read_ints(r["d"]).astype(np.int32))
            train.append(doc if pairs_given else np.unpackbits(np.frombuffer(r["f"], np.uint8), count=len(doc)) == 0)
            self.doc.append(doc.astype(np.int32))
            self.runs.append((r["run"], at, at + len(doc)))
            at += len(doc)
        self.vocabulary, index = np.unique(np.concatenate(words), return_inverse=True)
        word = np.repeat(index.astype(np.int32), np.concatenate(counts))
        train = np.concatenate(train)
        #: contexts: hashes of the part's contexts; elsewhere a context is its place among them
        self.contexts = np.unique(np.concatenate(known))
        key = (word.astype(np.int64) << 32) | np.concatenate([np.searchsorted(self.contexts, k)[c] for k, c in zip(known, contexts, strict=True)])
        del words, counts, known, contexts, index, word
        #: dishes: pairs of a word and a context; dish: that of each token
        pairs, dish = np.unique(key, return_inverse=True)
        self.dish = dish.astype(np.int32)
        self.word, self.context = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        self.count = np.bincount(self.dish, weights=train, minlength=len(pairs)).astype(np.int64)
        self.of_word = np.bincount(self.word, weights=self.count, minlength=len(self.vocabulary))


def _grouped(batches: Iterator[pa.RecordBatch]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for rows in batches:
        for r in rows.to_pylist():
            out.setdefault(r["kind"], []).append(r)
    return out


def _asks(kind: str, bucket: int, buckets: int, contexts: np.ndarray, values: list[np.ndarray], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows that ask for the sums of values by context: contexts go by the range of their hash. wanted: which to answer."""
    width = np.uint64(0xFFFFFFFFFFFFFFFF) // np.uint64(buckets) + np.uint64(1)
    to = (contexts // width).astype(np.int64) if buckets > 1 else np.zeros(len(contexts), np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1]))[: len(to)], len(to))
    for lo, hi in zip(cuts, cuts[1:]):
        more = {"f": np.packbits(wanted[lo:hi])} if wanted is not None else {}
        yield packed(kind, int(to[lo]), bucket, a=contexts[lo:hi], **{c: _ints(v[lo:hi]) for c, v in zip("bcde", values)}, **more)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each row that asks, sums over all rows, in the order of its contexts."""
    rows = [r for group in _grouped(batches).values() for r in group]
    if not rows:
        return
    keys = [np.frombuffer(r["a"], np.uint64) for r in rows]
    at = np.unique(np.concatenate(keys), return_inverse=True)[1]
    sums = [np.bincount(at, weights=np.concatenate([_read_ints(r[c]) for r in rows])) for c in "bcde" if rows[0][c] is not None]
    lo = 0
    for r, k in zip(rows, keys, strict=True):
        mine = at[lo : lo + len(k)]
        lo += len(k)
        if r["f"] is not None:
            mine = mine[np.unpackbits(np.frombuffer(r["f"], np.uint8), count=len(k)) == 1]
        # The range, in x, puts the answers to one bucket in order.
        yield packed("answer", int(r["run"]), x=float(r["bucket"]), **{c: _ints(s[mine]) for c, s in zip("bcde", sums)})


def _answers(rows: list[dict], column: str) -> np.ndarray:
    rows = sorted(rows, key=lambda r: r["x"])
    return np.concatenate([_read_ints(r[column]) for r in rows]) if rows else np.zeros(0, np.int64)


def _sums(values: list[float]) -> Iterator[pa.RecordBatch]:
    for i, x in enumerate(values):
        yield packed("sum", 0, i, float(x))


def _root_rows(words: np.ndarray, customers: np.ndarray, tables: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parent's customers of hot words, and sums over the others: customers, tables, words of one and of two customers."""
    shared = np.isin(words, hot)
    for w, n in zip(words[shared].view(np.int64).tolist(), customers[shared].tolist()):
        yield packed("hot", 0, w, float(n))
    yield from _sums([customers[~shared].sum(), tables[~shared].sum(), (customers[~shared] == 1).sum(), (customers[~shared] == 2).sum()])


def _first(hot: np.ndarray, buckets: int):
    """The first state, a table for each dish, of one bucket: rows words, many, contexts, ask0, sum, hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _grouped(batches).get("pairs")
        if not rows:
            return
        bucket, part = rows[0]["bucket"], _Part(rows)
        del rows
        some = part.of_word > 0
        place = np.cumsum(some) - 1  # of a word among those of training
        words, count = part.vocabulary[some], part.count
        single, many = count == 1, np.flatnonzero(count >= 2)
        singles = np.bincount(place[part.word[single]], minlength=len(words))
        customers = singles + np.bincount(place[part.word[many]], minlength=len(words))
        yield packed("words", bucket, a=words, b=_ints(singles), c=_ints(customers), d=_ints(np.minimum(customers, 1)))
        inside, at = np.unique(part.context[many], return_inverse=True)
        yield packed("many", bucket, a=part.contexts[inside], b=_ints(place[part.word[many]]), c=_ints(at), d=_ints(count[many]), e=_ints(np.ones(len(many), np.int64)))
        n = len(part.contexts)
        alone = np.bincount(part.context[single], minlength=n)
        guests = np.bincount(part.context, weights=count, minlength=n)
        yield packed("contexts", bucket, a=part.contexts, b=_ints(guests), c=_ints(alone), d=_ints(inside))
        wanted = np.zeros(n, bool)
        wanted[inside] = True
        yield from _asks("ask", bucket, buckets, part.contexts, [alone, np.bincount(part.context[many], minlength=n)], wanted)
        yield from _root_rows(words, customers, np.minimum(customers, 1), hot)
        yield packed("sum", 0, 4, float(count.sum()))
        yield packed("sum", 0, 5, float((~np.isin(words, hot)).sum()))
        yield packed("sum", 0, 6, float(single.sum()))
        yield packed("sum", 0, 7, float((count == 2).sum()))

    return run


def _sweep(totals: Totals, buckets: int, sweep: int, seed: int, keep: bool, last: bool):
    """One sweep of one bucket: rows words and many of the new state, ask for the next one, sum and hot. keep: what scoring
    needs of the state is in a row kept. last: there is no next state; asks for all contexts (row contexts), with their
    customers and their tables in all states that are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _grouped(batches)
        if "words" not in rows:
            return
        w, m = rows["words"][0], rows["many"][0]
        bucket = w["bucket"]
        words, singles, customers, tables = np.frombuffer(w["a"], np.uint64), *(_read_ints(w[c]) for c in "bcd")
        contexts, word, context, count, old = np.frombuffer(m["a"], np.uint64), *(_read_ints(m[c]) for c in "bcde")
        answers = rows.get("answer", [])
        base = _answers(answers, "b") if m["f"] is None else _read_ints(m["f"])  # dishes of one customer, in all
        by_context = base + _answers(answers, "c" if m["f"] is None else "b")
        whole, root_tables = totals.of_words(words, customers, tables)
        parent = totals.parent(whole[word], root_tables[word], old)
        weight = (STRENGTH + totals.discount * (by_context[context] - old)) * parent
        key = mix(words[word] ^ mix(contexts[context] + _salt(seed, sweep, 0)))
        new = seat(count, weight, totals.discount * parent, totals.discount, key).astype(np.int64)
        customers = singles + np.bincount(word, weights=new, minlength=len(words)).astype(np.int64)
        tables = totals.seat_root(customers, root_tables, words, sweep, seed).astype(np.int64)
        if keep:
            yield packed("kept", bucket, c=_ints(customers), d=_ints(tables), e=_ints(new))
        yield from _root_rows(words, customers, tables, totals.hot)
        if not last:
            yield packed("words", bucket, a=words, b=_ints(singles), c=_ints(customers), d=_ints(tables))
            yield packed("many", bucket, a=contexts, b=_ints(word), c=_ints(context), d=_ints(count), e=_ints(new), f=_ints(base))
            yield from _asks("ask", bucket, buckets, contexts, [np.bincount(context, weights=new, minlength=len(contexts))])
            return
        every = rows["contexts"][0]
        names, inside = np.frombuffer(every["a"], np.uint64), _read_ints(every["d"])
        values = [_read_ints(every["b"])]
        for state in [*(_read_ints(r["e"]) for r in sorted(rows.get("kept", []), key=lambda r: r["run"])), new]:
            sums = _read_ints(every["c"])
            sums[inside] += np.bincount(context, weights=state, minlength=len(inside)).astype(np.int64)
            values.append(sums)
        yield from _asks("ask", bucket, buckets, names, values)

    return run


def _score(states: list[Totals], hot_count: np.ndarray, buckets: int, ids: pa.DataType):
    """Average the sampled states' probabilities and sum their logs by document of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}
        for rows in batches:
            heads = np.array(rows.column("kind").to_pylist()) == "head"
            yield rows.filter(pa.array(heads))
            for kind, mine in _grouped(iter([rows.filter(pa.array(~heads)).drop_columns(["ids"])])).items():
                held.setdefault(kind, []).extend(mine)
        if "tokens" not in held:
            return
        part = _Part(held.pop("tokens"))
        answers = held.get("answer", [])
        inside = STRENGTH + _answers(answers, "b")[part.context]
        word, count, totals = part.word, part.count, states[0]
        known = part.of_word > 0
        many, mean = np.flatnonzero(count >= 2), np.zeros(len(count))
        for i, state in enumerate(states):
            tables = np.minimum(count, 1).astype(float)
            customers, root_tables = np.zeros(len(known)), np.zeros(len(known))
            for r in held.get("kept", []):
                if r["run"] == i:
                    customers[known], root_tables[known], tables[many] = _read_ints(r["c"]), _read_ints(r["d"]), _read_ints(r["e"])
            parent = state.parent(*state.of_words(part.vocabulary, customers, root_tables))
            by_context = _answers(answers, "cde"[i])[part.context]
            mean += (count - state.discount * tables + (STRENGTH + state.discount * by_context) * parent[word]) / inside
        whole = part.of_word
        if len(totals.hot):
            at = np.minimum(np.searchsorted(totals.hot, part.vocabulary), len(totals.hot) - 1)
            whole = np.where(totals.hot[at] == part.vocabulary, hot_count[at], whole)
        dish_score = np.log10(mean / len(states))
        dish_base = np.log10((whole + 1) / (totals.tokens + totals.words + 1))[word]
        dish_known = (whole > 0)[word].astype(float)
        no_ids = pa.nulls(1, pa.list_(ids))
        for (name, lo, hi), doc in zip(part.runs, part.doc, strict=True):
            dish = part.dish[lo:hi]
            some, at = np.unique(doc, return_inverse=True)
            sums = [np.bincount(at, weights=x[dish]) for x in (dish_base, dish_score, dish_known)]
            yield packed("part", _home(name, buckets), name, a=_ints(some), b=sums[0], c=sums[1].astype(np.float32), d=_ints(sums[2])).append_column("ids", no_ids)

    return run


def _gather(train_tokens: int):
    """One partition's runs: their documents with the sums over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, tuple] = {}
        sums: dict[int, list] = {}
        for rows in batches:
            ids = rows.column("ids")
            for i, r in enumerate(rows.drop_columns(["ids"]).to_pylist()):
                if r["kind"] == "head":
                    heads[r["run"]] = (ids[i].values, r["a"], r["b"])
                    continue
                at = _read_ints(r["a"])
                mine = [np.frombuffer(r["b"], float), np.frombuffer(r["c"], np.float32).astype(float), _read_ints(r["d"])]
                total = sums.setdefault(r["run"], [np.zeros(0), np.zeros(0), np.zeros(0, np.int64)])
                for k in range(3):
                    if len(total[k]) <= at[-1]:
                        total[k] = np.append(total[k], np.zeros(max(int(at[-1]) + 1, 2 * len(total[k])) - len(total[k]), total[k].dtype))
                    total[k][at] += mine[k]
        for name, (ids, held, length) in heads.items():
            base, score, known = (np.append(x, np.zeros(max(len(ids) - len(x), 0), x.dtype))[: len(ids)] for x in sums[name])
            yield batch(
                id=ids, held_out=pa.array(np.frombuffer(held, np.uint8) == 1), n_tokens=pa.array(_read_ints(length)), n_known=pa.array(known),
                train_tokens=pa.array(np.full(len(ids), train_tokens, np.int64)), base_score=pa.array(base), score=pa.array(score),
            )

    return run


def _totals(state: DataFrame, before: Totals | None, hot: np.ndarray, hot_count: np.ndarray, sweep: int, seed: int) -> Totals:
    """Sums of a state; HOT_WORDS and a few more rows come to the driver, where the hot words' parent customers sit down."""
    found = {(r["kind"], r["run"]): r["x"] for r in state.filter("kind in ('sum', 'hot')").groupBy("kind", "run").agg(F.sum("x").alias("x")).collect()}
    sums = [found.get(("sum", i), 0.0) for i in range(8)]
    customers = np.array([found.get(("hot", int(w)), 0.0) for w in hot.view(np.int64)])
    if before is None:
        words = sums[5] + (hot_count > 0).sum()
        root = discount_of(sums[2] + (customers == 1).sum(), sums[3] + (customers == 2).sum())
        before, tables = Totals(sums[4], words, discount_of(sums[6], sums[7]), root, hot), np.minimum(customers, 1.0)
    else:
        tables = before.seat_root(customers, before.hot_tables, hot, sweep, seed) if len(hot) else customers
    return Totals(before.tokens, before.words, before.discount, before.root_discount, hot, sums[0] + customers.sum(), sums[1] + tables.sum(), customers, tables)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, seed: int = 5, buckets: int | None = None) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    two = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % modulus == held, F.lit(False)).alias("held_out"),
    )
    if buckets is None:
        chars = two.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        buckets = max(8, -(-chars // BUCKET_CHARS))
    often = two.mapInArrow(tidy(_hot), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toPandas()
    hot = np.sort(often.word.to_numpy(np.int64).view(np.uint64))
    hot_count = np.zeros(0)
    if len(hot):
        counted = two.mapInArrow(tidy(_hot_counts(hot)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        hot_count = np.zeros(len(hot))
        hot_count[np.searchsorted(hot, counted.word.to_numpy(np.int64).view(np.uint64))] = counted.n.to_numpy()
    with_ids = T._parse_datatype_string(PACKED).add("ids", T.ArrayType(kind))
    dealt = two.mapInArrow(tidy(_deal(hot, buckets, arrow)), with_ids)

    def met(rows: DataFrame, run, schema=PACKED) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), schema)

    def of(rows: DataFrame, *kinds: str) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds))

    first = materialise(met(two.mapInArrow(tidy(_deal_pairs(hot, buckets)), PACKED), _first(hot, buckets)), "state", by="kind")
    totals, state = _totals(first, None, hot, hot_count, 0, seed), first
    kept: list[tuple[Totals, DataFrame]] = []

    def numbered(i: int, table: DataFrame) -> DataFrame:
        return of(table, "kept").withColumn("run", F.lit(i).cast("long"))

    for sweep in range(1, BURN + SAMPLES + 1):
        last = sweep == BURN + SAMPLES
        answers = materialise(met(of(state, "ask"), _answer), "answers")
        rows = of(state, "words", "many").unionByName(answers)
        if last:
            rows = rows.unionByName(of(first, "contexts"))
            for i, (_, table) in enumerate(kept):
                rows = rows.unionByName(numbered(i, table))
        old, state = state, materialise(met(rows, _sweep(totals, buckets, sweep, seed, sweep > BURN, last)), "state", by="kind")
        totals = _totals(state, totals, hot, hot_count, sweep, seed)
        if sweep > BURN:
            kept.append((totals, materialise(of(state, "kept"), "kept")))
        release(answers)
        if old is not first:
            release(old)
        collect_shuffles(spark)
    release(first)
    answers = materialise(met(of(state, "ask"), _answer), "answers")
    release(state)
    collect_shuffles(spark)
    rows = dealt.unionByName(answers, allowMissingColumns=True)
    for i, (_, table) in enumerate(kept):
        rows = rows.unionByName(numbered(i, table), allowMissingColumns=True)
    sent = met(rows, _score([t for t, _ in kept], hot_count, buckets, arrow), with_ids).repartitionById(buckets, F.col("bucket"))
    out = T.StructType().add("id", kind).add("held_out", T.BooleanType())
    for c in ("n_tokens", "n_known", "train_tokens"):
        out = out.add(c, T.LongType())
    out = out.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    return sent.mapInArrow(tidy(_gather(int(totals.tokens))), out).withColumnRenamed("id", id_col)
