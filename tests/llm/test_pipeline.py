"""The pipeline's stages, each held against its operator's definition on its own input, and the whole run."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import oracle
from test_ops import root_of, slow_fingerprint

from spanloom.llm import toxicity


def test_stages(spark):
    docs = spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{oracle.SF_DIR}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]

    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    clean = stages["toxicity"](spark, docs, oracle.SF_DIR)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert {*rows} == {d for d, s in scores.items() if s < 0.7}

    once = stages["exact_dedup"](spark, clean, oracle.SF_DIR)
    assert once.columns == docs.columns
    groups = defaultdict(list)
    for d, t in rows.items():
        groups[t or ""].append(d)
    kept = {max(g) for g in groups.values()}
    assert {r.doc_id for r in once.collect()} == kept

    apart = stages["simhash_near_dedup"](spark, once, oracle.SF_DIR)
    assert apart.columns == docs.columns
    fps = {d: slow_fingerprint(rows[d]) for d in kept}
    links = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 4]
    last = {*root_of(links, fps).values()}
    assert {r.doc_id for r in apart.collect()} == last

    packed = corpus_pipeline.run(spark, oracle.SF_DIR).collect()
    assert {r.doc_id for r in packed} == last
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, oracle.SF_DIR).count() == 0
