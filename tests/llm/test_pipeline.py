"""The whole pipeline on a small table, each stage against a plain version of it."""

import os
from collections import Counter

import corpus_pipeline
from parley.llm import queries, tokens
from tests.llm.brute import linked_components


def test_stages(spark, rows, docs, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    kept = [spark.read.parquet(f"{path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], path).write.parquet(f"{path}/{name}")
        kept.append(spark.read.parquet(f"{path}/{name}"))
    start, spoken, single, apart, mixed, packed = ([r.asDict() for r in k.collect()] for k in kept)
    assert all(k.columns == docs.columns for k in kept[:-1])
    letters = [r for r in start if any(c.isalpha() for c in r["text"] or "")]
    key = lambda r: (r["doc_id"], r["text"])
    assert Counter(map(key, spoken)) == Counter(map(key, letters))
    highest = {}
    for r in spoken:
        highest[r["text"]] = max(r["doc_id"], highest.get(r["text"], -1))
    assert Counter(map(key, single)) == Counter((i, t) for t, i in highest.items())
    components = linked_components([key(r) for r in single])
    assert Counter(map(key, apart)) == Counter(key(r) for r in single if components[r["doc_id"]][1] == r["doc_id"])
    whole = {r["doc_id"]: r["text"] for r in apart}
    assert all(r["text"] == whole[r["doc_id"]] or set(r["text"].split()) <= set(whole[r["doc_id"]].split()) for r in mixed)
    assert sum(len(tokens.ids(r["text"])) + 1 for r in mixed) == sum(r["length"] for r in packed)


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES or os.path.exists(corpus_pipeline.__file__)
