import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark):
    import corpus_pipeline
    from arborlane.llm import exact_dedup, ngram_join
    from arborlane.session import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF), "t")
        sizes.append(docs.count())
        if name == "packing":
            assert docs.agg({"length": "sum"}).first()[0] == docs.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0]
            continue
        assert docs.columns == columns
        if name == "exact dedup":
            expected = exact_dedup.exact_groups(before).filter("kept").select("doc_id")
            assert sorted(expected.collect()) == sorted(docs.select("doc_id").collect())
        if name == "n-gram Jaccard join":
            expected = ngram_join.components_of(before).select("component_id").distinct()
            assert sorted(expected.collect()) == sorted(docs.select("doc_id").collect())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] <= sizes[0] and sizes[3] >= sizes[2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_run_against_brute_force(spark):
    """All five stages worked out anew: who is kept, which copies go, how often documents are used, every piece."""
    from collections import Counter, defaultdict
    import re
    import zlib

    import numpy as np
    from test_operators import _jaccard_components, _mixed, _words
    from tokenizers import Tokenizer

    import corpus_pipeline
    from arborlane.llm import mixing, packing, quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality.classify(docs, labels).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in kept]
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t, s))
    rows = [min(g)[1:] for g in groups.values()]
    least = {c for _, _, c in _jaccard_components(rows)}
    rows = sorted(r for r in rows if r[0] in least)
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = {r["source"]: r["weight"] for r in mixing.usage(left, mixing.Target(repeats=corpus_pipeline.REPEATS)).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(_words(t))
    budget = max(n / weight[s] for s, n in size.items() if n)
    shares = {s: n / sum(size.values()) for s, n in size.items()}
    assert max(weight[s] / p for s, p in shares.items() if p) <= corpus_pipeline.REPEATS * min(weight[s] / p for s, p in shares.items() if p) * (1 + 1e-9)
    uses = Counter()
    for (i, *_, epoch, _, _), n in _mixed(rows, weight, budget, mixing.BLOCK_TOKENS, mixing.BLOCK_DOCS).items():
        uses[i] += n if epoch is not None else 0
    tokenizer, expected = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            expected[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += uses[i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == +expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(s)[k][0] == sum(n for _, n in sorted(s)[:k]) for s in sequences.values() for k in range(len(s))) and max(sum(n for _, n in s) for s in sequences.values()) <= 1024


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from arborlane.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, rel = QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(rel.columns), name
        assert sorted(map(tuple, got.select(rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr), name
