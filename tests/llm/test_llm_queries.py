"""The numbered queries and the pipeline over the given tables."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from reqsieve.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLES:
        assert compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None
    else:
        table = "pages" if "warc" in name else "documents"
        want = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        assert QUERIES[name](spark, sf_dir).count() == want


def test_pipeline_stages(spark, sf_dir):
    """Each stage by a plainer path: rules scored, brute-force classes, contamination, rates."""
    from test_llm_operators import brute_classes

    from reqsieve.llm import decontaminate, mixing, quality
    from reqsieve.llm.common import table

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels))
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    once = {rows[i][0] for i in brute_classes(rows)}
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    clean = {r.doc_id for r in found.where("NOT contaminated").collect()} & once
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(left).collect()}
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
