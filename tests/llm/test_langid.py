import zlib

import numpy as np
import pytest

from netweave.llm import langid
from netweave.llm.queries import QUERIES


def test_query_is_accurate_on_held_out_documents(spark, small):
    rows = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, small).collect()}
    given = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(given)
    assert all(rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in given)
    held = [r for r in given if rows[r["doc_id"]]["held_out"] and r["lang"]]
    right = np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held])
    assert len(held) > 20 and right > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_prediction_ignores_other_columns(spark):
    rows = [(i, ("the house is big " if i % 2 else "das haus ist gross ") * 9, "en" if i % 2 else "de", "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learn(frame)
    assert model.families == ["germanic"] and list(model.pairs) == [("de", "en")]
    shown = spark.createDataFrame([(100, "das haus", "en"), (100, "the house", None)], "doc_id long, text string, lang string")
    assert sorted(r["lang_pred"] for r in langid.predict(shown, model).collect()) == ["de", "en"]


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame(
        [(1, None, "en"), (None, "hello there", "en"), (2, "12 34 !", None), (2, "", "de"), (3, "hello", "en")],
        "doc_id long, text string, lang string",
    )
    rows = langid.identify(frame).collect()
    assert len(rows) == 5
    for r in rows:
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert sorted(r["lang_pred"] for r in rows) == ["en", "en", "und", "und", "und"]
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert langid.identify(frame.limit(0)).count() == 0
    assert langid.keep_identified(frame).columns == frame.columns and langid.keep_identified(frame).count() == 2


def plain_counts(text):
    """All n-grams of the text at once."""
    row, last = [32], True
    for c in text.lower():
        if c.isalpha() or last:
            row.append(ord(c) if c.isalpha() else 32)
        last = c.isalpha()
    row, mask = [*row, 32], 0xFFFFFFFF
    counts = np.zeros(langid.DIMENSIONS, np.int64)
    for i in range(len(row) - 1):
        pair = (row[i] * 0x9E3779B1 + row[i + 1] * 0x85EBCA77) & mask
        counts[(pair * 0x9E3779B1 & mask) >> 20] += 1
        if i + 2 < len(row):
            triple = (pair * 0xC2B2AE3D + row[i + 2] * 0x27D4EB2F) & mask
            counts[(triple * 0x9E3779B1 & mask) >> 20] += 1
    return counts


@pytest.mark.parametrize("text", ["abc déf, " * 40, "a", " a", "a ", "..a..b..", "Σίσυφος ΣΑΣ", "x\U00020000y \U0001f600z", "a1b2c3" * 9])
def test_pieces_do_not_show(text):
    for piece in (1, 2, 3, 7, 16, 1 << 20):
        assert langid.ngram_counts(text, piece).tolist() == plain_counts(text).tolist()


@pytest.mark.parametrize("text", ["\U0001f600 \U0001f389 !!", "123 ..", "\U0001d7cf\U0001d7d0", "\U00010100\U00010107", "", " \n"])
def test_texts_without_a_letter(spark, text):
    assert langid.ngram_counts(text) is None
    rows = [(i, "the house is big", "en", text) for i in range(20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, other string"))
    (row,) = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert langid.keep_identified(spark.createDataFrame([(i, text, None) for i in range(3)], "doc_id long, text string, lang string")).count() == 0
