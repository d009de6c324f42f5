from collections import Counter

import numpy as np
from test_bpe import LIBRARY
from test_lines import plain as plain_lines
from test_parity import plain_components

import corpus_pipeline
from netweave.llm import langid


def test_every_stage_against_its_brute_force_version(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(1000, "123 -- 456", None, "src1", 10), (1001, None, "en", None, None), (None, "no id but words here", "en", "src2", 20)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stages, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages.append(docs.collect())
        if name != "bpe_encoding":
            assert docs.columns == columns
    identified, cleaned, single, mixed, encoded = stages
    given = [*spark.read.parquet(f"{small}/documents.parquet").collect(), *spark.createDataFrame(extra, spark.read.parquet(f"{small}/documents.parquet").schema).collect()]
    assert sorted(map(str, identified)) == sorted(str(r) for r in given if langid.ngram_counts(r["text"] or "") is not None)

    order = sorted(identified, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = [(i, text) for i, text, n, gone in plain_lines([(r["doc_id"], r["text"]) for r in order]) if gone < n or n == 0]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in cleaned))) == sorted(map(str, want))
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned)

    found = plain_components([(r["doc_id"], r["text"]) for r in cleaned if r["doc_id"] is not None])
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted({c for _, c in found.values()})
    assert sum(r["doc_id"] is None for r in single) == 1

    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in single} and max(copies.values()) <= 3

    texts = {r["doc_id"]: r["text"] for r in single}
    assert Counter(r["doc_id"] for r in encoded) == copies
    for r in encoded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_is_registered(spark, small):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"](spark, small).count() > 0
