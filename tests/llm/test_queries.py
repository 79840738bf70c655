"""The registered corpus queries against their SQL, and the pipeline end to end."""

import collections
import os

import corpus_pipeline
import duckdb
import pytest
from graderoom.llm.queries import ORACLES, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    order = [names.index(c) for c in df.columns]
    want = collections.Counter(tuple(row[i] for i in order) for row in rel.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.collect()) == want


def test_pipeline(spark):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    out = corpus_pipeline.run(spark, SF_SMALL).orderBy("start").collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= known
    assert [r.start for r in out][0] == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))
    assert [r.doc_id for r in out] != sorted(r.doc_id for r in out)
