import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netweave.llm import bpe
from netweave.llm.queries import QUERIES

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def found(rows):
    return sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)


@given(st.lists(st.sampled_from(["a", "The", " ", "\n", "\xa0", "é", "é", "́", "Σ", "12", "'s", "<|endoftext|>", "\U0001f600", "\x85", "x" * 40]), max_size=60).map("".join))
@settings(max_examples=150, deadline=None)
def test_chunks_and_repairs_agree_with_the_library(text):
    own = bpe.encoder(PATH)
    whole = np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    data = text.encode()
    assert b"".join(bpe.chunks(data)) == data
    assert bpe.encode_text(own, data, {}) == whole
    shared = {bpe.digest(c): own.ids(c[slice(*bpe.core(c))]) for c in bpe.chunks(data) if bpe.core(c)}
    assert bpe.encode_text(own, data, shared) == whole


def test_query_agrees_with_the_library_on_every_document(spark, small):
    given_rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op6_bpe_chunks"](spark, small).collect()}
    assert rows == {r["doc_id"]: plain(r["text"]) for r in given_rows}


def test_shared_chunks_are_found_and_used(spark):
    from netweave.llm.common import file_exists

    passage = " ".join(f"word{i} again" for i in range(900))
    frame = spark.createDataFrame([(i, f"start {i} {passage} end {i}") for i in range(40)], "doc_id long, text string")
    folder = bpe.share_chunks(frame, PATH)
    assert file_exists(folder, "split-0") and len(bpe._shared_ids(folder, 0)) > 5
    assert found(bpe.encode_documents(frame).collect()) == sorted(plain(r["text"]) for r in frame.collect())


def test_nulls_repeats_empty_and_long_texts(spark):
    texts = [None, "", "same", "same", "x" * 5000, "long word " * 30_000, "\n\t \r"]
    frame = spark.createDataFrame([(None if i == 2 else 1, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(frame, with_ids=True).collect()
    assert found(rows) == sorted(map(plain, texts)) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bpe.encode_documents(frame.limit(0)).count() == 0


def test_rows_are_encoded_a_few_at_once(spark, monkeypatch):
    """The ids that a task holds are those of some rows, not of a whole batch of Spark's."""
    monkeypatch.setattr(bpe, "ROWS_AT_ONCE", 3)
    sizes = spark.createDataFrame([(k, f"word {k} and more") for k in range(20)], "doc_id long, text string").coalesce(1)
    seen = bpe.encode_documents(sizes, PATH, with_ids=True)
    whole = bpe.Encoder(PATH)
    assert {r["doc_id"]: bytes(r["ids"]) for r in seen.collect()} == {k: whole.whole(f"word {k} and more".encode()) for k in range(20)}


class Counted:
    """The library's tokenizer, and how many stretches it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.given += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_words_are_merged_by_their_pieces():
    """The library need not read anew every word that differs in case or signs only."""
    own = bpe.Encoder(PATH)
    own.tokenizer = Counted(own.tokenizer)
    text = "Again again, AGAIN. (again) \"Again\"-again again2again _Über über; ÜBER"
    assert own.ids(text.encode()) == library(text)
    assert own.tokenizer.given == 0 and {"again", "über"} <= own.pieces.known.keys()
    assert own.ids("it's again e\u0301 İ <|endoftext|>".encode()) == library("it's again e\u0301 İ <|endoftext|>")
    assert own.tokenizer.given == 4


def library(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PARTS = ["a", "The", "É", "ŉ", "Ⱥ", "İ", "ǅ", "×", "²", "ª", "_", "7", "'", "'s", "'LL", "<|", "<|endoftext|>", " ", "\t", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\xad", "\u0301", "Σ", "日本", "-", "...", "\x00"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_texts_encoded_together_agree_with_the_library(texts):
    own = bpe.encoder(PATH)
    ids = bpe.encode_texts(own, [t.encode() for t in texts], {})
    assert ids == [library(t) for t in texts]
    read = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.decode(ids) == [LIBRARY.decode(i, skip_special_tokens=False).encode() for i in read]


def test_small_units_and_memories_do_not_show(monkeypatch):
    texts = [" ".join(f"Word{(i * k) % 97}x, {k}é'd" for k in range(300)) for i in range(5)]
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 500)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    own = bpe.Encoder(PATH)
    for _ in range(2):
        assert bpe.encode_texts(own, [t.encode() for t in texts], {}) == [library(t) for t in texts]
    assert len(own.pieces.known) < 300


def test_another_reader_goes_without_the_quick_one(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        given_vocabulary = json.load(f)
    given_vocabulary["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(given_vocabulary, f)
    own, other = bpe.Encoder(path), Tokenizer.from_file(path)
    assert own.quick is None and bpe.Encoder(PATH).quick is not None
    text = "Some Words, and some"
    assert own.ids(text.encode()) == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
