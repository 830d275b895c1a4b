"""URL filters by a sort-merge range join.

Every host becomes a canonical key, its labels reversed with a dot after each (``org.example.blog.``). A rule's host
prefix is then an interval of keys, and the intervals of any two rules are nested or disjoint. Pages are sorted by key;
one sweep over pages and rule bounds keeps a stack of the rules whose interval holds the current key, longest host on
top, and each page asks the rules on the stack for the longest that its path starts with.

Rules are sorted once on the driver, where they come from. They are sent to the tasks in blocks of at most ``block``
rules, one sweep for each block, so that what is broadcast is bounded; a page keeps its best rule over the blocks.

Skew: the range partitioning orders by key and then by a hash of the row's place in the input, so pages of one host, also
repeated ones and those without an id, split over partitions.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; a url that no rule fits
gets the method's verdict, ``allow``; of rules of equal length the one with the longer host wins, then ``block``;
repeated rows are judged each; an empty table or no rules give no rows or only the method's verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.session import tasks_for

DEFAULT = "allow"
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """org.example.blog. for blog.example.org; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def rule_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def _sweep(rules: list[tuple[str, str, str, str]]):
    """rules: (key, path, rule, verdict), sorted by key as UTF-8 bytes."""
    by_key: dict[bytes, list] = {}
    for key, path, rule, verdict in rules:
        by_key.setdefault(key.encode(), []).append((path, rule, verdict))
    bounds = sorted(by_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        stack: list[bytes] = []
        at, before = 0, None
        for batch in batches:
            best_rule, best_verdict = [], []
            for key, path in zip(batch.column("hkey").to_pylist(), batch.column("path").to_pylist(), strict=True):
                now = key.encode()
                if now != before:
                    if before is None:  # rules that began before this partition: the prefixes of its first key
                        at = bisect_left(bounds, now)
                        ends = [i + 1 for i, c in enumerate(now) if c == 46]
                        stack = [now[:e] for e in ends if now[:e] in by_key and now[:e] < now]
                    while stack and not now.startswith(stack[-1]):
                        stack.pop()
                    while at < len(bounds) and bounds[at] <= now:
                        if now.startswith(bounds[at]):
                            stack.append(bounds[at])
                        at += 1
                    before = now
                found = None
                for bound in stack:
                    for rule_path, rule, verdict in by_key[bound]:
                        if path.startswith(rule_path):
                            mine = (len(rule), len(bound), verdict == "block", rule, verdict)
                            found = mine if found is None or mine > found else found
                best_rule.append(found and found[3])
                best_verdict.append(found and found[4])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best_rule, pa.string()), pa.array(best_verdict, pa.string())],
                names=[*batch.schema.names, "new_rule", "new_verdict"],
            )

    return run


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
    block: int = 100_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row. rules: (verdict, host, path)."""
    url = F.col(f"`{url_col}`").cast("string")
    out = pages.select(
        F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("at")
    ).withColumn("hkey", host_key(F.col("host")))
    n = tasks_for(pages.sparkSession)
    out = out.repartitionByRange(n, "hkey", F.xxhash64("at")).drop("at").sortWithinPartitions("hkey")
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    ordered = sorted(((rule_key(h), p, f"{h}{p}", v) for v, h, p in set(rules)), key=lambda r: r[0].encode())
    for i in range(0, len(ordered), block):
        swept = out.mapInArrow(
            _sweep(ordered[i : i + block]),
            "id {}, host string, path string, hkey string, rule string, verdict string, new_rule string, new_verdict string".format(
                pages.schema[id_col].dataType.simpleString()
            ),
        )
        order = lambda rule, verdict: F.struct(F.length(rule), F.instr(rule, "/"), F.col(verdict) == "block")
        better, old = order("new_rule", "new_verdict"), order("rule", "verdict")
        wins = F.col("new_rule").isNotNull() & (F.col("rule").isNull() | (better > old))
        out = swept.select(
            "id", "host", "path", "hkey",
            F.when(wins, F.col("new_rule")).otherwise(F.col("rule")).alias("rule"),
            F.when(wins, F.col("new_verdict")).otherwise(F.col("verdict")).alias("verdict"),
        )
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
