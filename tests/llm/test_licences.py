import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import licences
from netweave.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain_base(text):
    own = plain_words(text)
    found = [(i, label) for phrase, label in BASE.items() for i in range(len(own)) if tuple(own[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in found]
    return len(own), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def every_place(index, own):
    """Without the index: each template at each start."""
    found = []
    for number, entry in enumerate(index.entries):
        starts = range(-len(entry.words), len(own) + len(entry.words))
        found += [(number, s, share) for s, share in licences.verified(entry, own, list(starts))]
    return found


def check_rows(frame, texts):
    assert frame.columns == COLUMNS
    rows = sorted(frame.collect(), key=str)
    assert sorted(map(str, ((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows))) == sorted(str(plain_base(t)) for t in texts)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    return rows


def test_query_agrees_with_plain_search(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = check_rows(QUERIES["op12_licence_scan"](spark, small), [r["text"] for r in documents])
    index = licences.Index(licences.TEMPLATES, *licences.document_frequencies(spark.read.parquet(f"{small}/documents.parquet")))
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in rows}
    for r in documents:
        places = every_place(index, licences.words(r["text"]))
        labels = ",".join(sorted({index.entries[n].template.label for n, _, _ in places}))
        assert found[r["doc_id"]] == (labels, max((x for _, _, x in places), default=0.0))
    assert any("mit" in r["labels"].split(",") for r in rows) and any("apache-2.0" in r["labels"] for r in rows)


NOTICE_WORDS = sorted({w.decode() for t in licences.TEMPLATES for w in licences.words(t.text)})


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_index_loses_no_place(data):
    """Notices with lost, added and changed words among others; frequencies at will."""
    frequencies = {w.encode(): data.draw(st.integers(0, 50)) for w in data.draw(st.lists(st.sampled_from(NOTICE_WORDS), max_size=12))}
    index = licences.Index(licences.TEMPLATES, 50, frequencies)
    text = []
    for template in data.draw(st.lists(st.sampled_from(licences.TEMPLATES), max_size=4)):
        own = licences.words(template.text)
        for _ in range(data.draw(st.integers(0, 3))):
            at = data.draw(st.integers(0, len(own)))
            own[at : at + data.draw(st.integers(0, 1))] = [w.encode() for w in data.draw(st.lists(st.sampled_from([*NOTICE_WORDS, "x"]), max_size=1))]
        text += own + [b"the"] * data.draw(st.integers(0, 3))
    assert index.places(text) == every_place(index, text)


def test_edited_notices_are_found_and_lookalikes_are_not(spark):
    filler = "plain words of no interest " * 10
    cases = {
        1: (f"{filler}\nReleased under the MIT License. {filler}", "mit"),
        2: ("permission is hereby granted free of any charge to each individual obtaining a copy of this fine software and associated documentation files", "mit"),
        3: ("the apache people licensed a version 2.0 under water", ""),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        5: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        6: ("All rights, reserved! all RIGHTS reserved", "reserved"),
        7: ("MIT License", ""),
        8: (filler, ""),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(100 + i, filler) for i in range(40)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in check_rows(licences.label_licences(frame), [t for t, _ in cases.values()] + [filler] * 40)}
    assert {i: rows[i]["labels"] for i in cases} == {i: x for i, (_, x) in cases.items()}
    assert rows[1]["score"] == 1.0 and 0.7 <= rows[2]["score"] < 1 and (rows[6]["n_base"], rows[6]["first_word"], rows[6]["last_word"]) == (2, 0, 3)


def test_places_are_spans_of_words(spark):
    frame = spark.createDataFrame([(1, "x y Released under the MIT License z")], "doc_id long, text string")
    (row,) = licences.find_licences(frame).collect()
    assert [(p["label"], p["phrase"], p["first_word"], p["last_word"], p["share"]) for p in row["places"] if p["share"] == 1.0] == [("mit", False, 2, 6, 1.0)]


def test_nulls_empty_long_repeated_rows_and_clashing_columns(spark):
    long = "general public license " * 40_000
    texts = [None, "", "cc by", "cc by", "\x00\x7f", long, "cc " * 20_000 + "by", "é cc by ﬁ"]
    frame = spark.createDataFrame([(None if i == 2 else 1, t, "own", [1.0]) for i, t in enumerate(texts)], "doc_id int, text string, label string, places array<double>")
    rows = check_rows(licences.label_licences(frame), texts)
    assert max(r["n_base"] for r in rows) == 40_000
    assert licences.label_licences(frame.limit(0)).collect() == []


@pytest.mark.parametrize("template", licences.TEMPLATES, ids=lambda t: t.text[:30])
def test_each_template_finds_itself(template):
    index = licences.Index(licences.TEMPLATES, 1000, {})
    found = {index.entries[n].template: x for n, _, x in index.places(licences.words("before " + template.text + " after"))}
    assert found[template] == 1.0
