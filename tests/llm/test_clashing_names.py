"""Columns of the user that are named like what the operators use inside, through the operators and all stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netweave.llm import lines, mixing, parity

NAMES = [
    "_doc", "_version", "_runs", "_deleted", "doc", "version", "runs", "n_lines", "n_deleted", "old", "given", "row", "first", "last", "_copy", "kept_id", "copy", "id",
    "node", "label", "key", "task", "n", "bits", "n_shingles", "component_id", "mix_size", "mix_pattern", "mix_key", "mix_place", "mix_copy", "size", "pattern", "copies",
    "taken", "target", "held_out", "lang_pred", "score", "kept",
]


@pytest.fixture
def documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{name}:"), F.col("doc_id")).alias(name) for name in NAMES])


def as_given(rows):
    return all(r[name] == f"{name}:{r['doc_id']}" for r in rows for name in NAMES)


def test_each_stage_keeps_the_columns(spark, small, documents, tmp_path):
    plain = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        documents, plain = (stage(spark, d, small) for d in (documents, plain))
        for kind, frame in (("own", documents), ("plain", plain)):
            frame.write.parquet(str(tmp_path / f"{name}-{kind}"))
        documents, plain = (spark.read.parquet(str(tmp_path / f"{name}-{kind}")) for kind in ("own", "plain"))
        rows = documents.collect()
        assert documents.columns == [*plain.columns, *NAMES] and as_given(rows)
        assert sorted(str(r[: len(plain.columns)]) for r in rows) == sorted(str(tuple(r)) for r in plain.collect())
    encoded = corpus_pipeline.STAGES[-1][1](spark, documents, small)
    assert sorted(map(str, encoded.collect())) == sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, plain, small).collect()))


def test_operators_keep_the_columns(spark, documents):
    found = lines.dedupe_lines(documents)
    assert found.columns == [c for c in documents.columns if c not in ("n_lines", "n_deleted")] + ["n_lines", "n_deleted"]
    assert all(r["_doc"] == f"_doc:{r['doc_id']}" and isinstance(r["n_lines"], int) for r in found.collect())
    assert as_given(parity.keep_one(documents).collect())
    assert as_given(mixing.mix_rows(documents, F.array("source")).collect())
    assert mixing.mix(documents, F.array("source")).count() == documents.count()


def test_empty_and_repeated_rows_through_all_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    for kind, frame in (("empty", docs.limit(0)), ("repeated", docs.unionByName(docs).unionByName(docs))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, small).write.parquet(str(tmp_path / f"{name}-{kind}"))
            frame = spark.read.parquet(str(tmp_path / f"{name}-{kind}"))
            if name == "near_duplicates":
                assert frame.count() == frame.select("doc_id").distinct().count()
        assert (frame.count() == 0) == (kind == "empty")
