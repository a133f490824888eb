"""The pipeline against a plain re-statement over the same documents, and the registered SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest
from test_corpus_operators import SF, brute_components, brute_hits

import corpus_pipeline
from learnlake.llm import decontaminate, quality, queries, toxicity

SMALL = "documents embeddings pages benchmark labels conversations".split()


def test_stages_equal_a_plain_restatement(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    seen = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        seen[name] = [tuple(r) for r in frame.collect()]
        frame = spark.createDataFrame(seen[name], frame.schema)

    model = quality.fit(docs, labels)
    own = model.probability([r[1] for r in rows])
    sites = defaultdict(list)
    for r, p in zip(rows, own):
        sites[r[3], r[2]].append(p)
    scored = spark.createDataFrame([(k, r[3], r[2], float(p)) for k, (r, p) in enumerate(zip(rows, own))], "doc_id long, host string, path string, own double")
    share = {(s["host"], s["path"]): s["site_share"] for s in quality.site_posteriors(scored).collect()}
    logit = lambda p: math.log(p / (1 - p))
    rows = [r for r, p in zip(rows, own) if logit(p) - logit(model.base) + logit(share[r[3], r[2]]) >= 0]
    assert Counter(rows) == Counter(seen["quality classifier"])

    judge = toxicity.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if judge.score(r[1]) < 0.3]
    assert Counter(rows) == Counter(seen["toxicity"])

    stays = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    rows = [r for r in rows if r[0] in stays]
    assert Counter(rows) == Counter(seen["n-gram Jaccard join"])

    cut = seen["benchmark decontamination"]
    clean = {r[0]: r for r in rows if not brute_hits(r[1], items, decontaminate.WINDOW)[1]}
    assert all(clean[r[0]] == r for r in cut if r[0] in clean) and clean.keys() <= {r[0] for r in cut}
    assert all(brute_hits(r[1], items, decontaminate.WINDOW)[1] == 0 for r in cut) and len(cut) <= len(rows)

    pieces = seen["best-fit packing"]
    assert {p[0] for p in pieces} == {r[0] for r in cut}
    filled = defaultdict(int)
    for p in pieces:
        filled[p[5]] += p[3]
    assert max(filled.values()) <= 2048


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in SMALL:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want


def test_whole_tables_are_registered():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5
