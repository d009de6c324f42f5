import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netweave.llm import align
from netweave.llm.queries import QUERIES

A_PATH, B_PATH = align.vocabulary_path(align.FIRST), align.vocabulary_path(align.SECOND)
OWN = align.vocabularies(A_PATH, B_PATH)
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain(text):
    """Groups and links of whole texts, token by token."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    given_bytes = (" " + text).encode()
    if b"".join(OWN.a_bytes[i] for i in a) != given_bytes or b"".join(OWN.b_bytes[i] for i in b) != given_bytes:
        return [], [], [], []
    groups, links = [], []
    i = j = a_from = b_from = 0
    ga, gb = [], []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        a_end, b_end = a_from + len(OWN.a_bytes[a[i]]), b_from + len(OWN.b_bytes[b[j]])
        if a_end <= b_end:
            ga.append(a[i])
        if b_end <= a_end:
            gb.append(b[j])
        if a_end == b_end:
            groups.append((ga, gb))
            ga, gb = [], []
        if a_end <= b_end:
            i, a_from = i + 1, a_end
        if b_end <= a_end:
            j, b_from = j + 1, b_end
    assert i == len(a) and j == len(b) and not ga and not gb
    return a, b, groups, links


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(rows):
    found = [(i, *plain(t)) for i, t in rows]
    holds = Counter(pair for *_, links in found for pair in set(links))
    top = {}
    for (x, _), n in holds.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(
        (
            -1 if i is None else i, len(a), len(b), len(groups), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links),
            hashlib.sha256(written(groups).encode()).hexdigest() if a else "",
        )
        for i, a, b, groups, links in found
    )


def rows_of(frame):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in frame.collect())


PARTS = ["a", "The", " ", "  ", "\n", "\t ", "\xa0", "é", "é", "'s", "12", "<|endoftext|>", "<s>", "<0x41>", "▁", "\U0001f600", "\x85", "\x1c", " ", "ﬁ", "漢字", "-", "…", "_", "​", "᠎", "x" * 30, "ing "]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_pieces_give_what_whole_texts_give(text):
    a, b, groups, links = plain(text)
    found, again, _ = align.align_texts(align.Aligner(OWN), [text, text, "other words"], keep_groups=True)
    assert found.numbers.tolist() == again.numbers.tolist() == [len(a), len(b), len(groups), len(links)]
    assert found.groups == again.groups == written(groups)
    size = len(OWN.b_bytes)
    assert dict(zip(found.keys.tolist(), found.counts.tolist())) == Counter(x * size + y for x, y in links)


@given(st.lists(st.one_of(st.text(st.characters(max_codepoint=0x24F), max_size=8), st.text(max_size=4), st.sampled_from(["'ll", "don't", "'S", " 12", "½³ª"])), max_size=12).map(" ".join))
@settings(max_examples=400, deadline=None)
def test_the_quick_reader_cuts_like_the_other(text):
    a, b, groups, links = plain(text)
    (found,) = align.align_texts(align.Aligner(OWN), [text], keep_groups=True)
    assert found.groups == written(groups) and found.numbers.tolist() == [len(a), len(b), len(groups), len(links)]
    if align.SETTLED.match(text):
        assert OWN.quick.encode_ordinary(" " + text) == A.encode(" " + text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_terminals_are_the_components(steps, data):
    ends = np.cumsum(steps)
    inner = st.lists(st.integers(1, int(ends[-1])), max_size=60)
    b_ends = np.unique([*data.draw(inner), int(ends[-1])])
    terminal = align.terminal_tokens(ends, b_ends)
    both = sorted(set(ends.tolist()) & set(b_ends.tolist()))
    component = [np.searchsorted(both, e) for e in [*ends.tolist(), *b_ends.tolist()]]
    assert len(set(zip(component, terminal.tolist()))) == len(both) == len(set(terminal.tolist()))
    assert all(t >= len(ends) and b_ends[t - len(ends)] == both[c] for c, t in zip(component, terminal.tolist()))


def test_query_agrees_with_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    frame = QUERIES["op13_token_alignment"](spark, small)
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(frame) == expected(rows)


def test_nulls_repeats_ties_long_texts_and_clashing_columns(spark, monkeypatch):
    texts = [None, "", "same text", "same text", "a▁b", "x" * 5000, "long words here " * 5000, "tie tie", " \n"]
    rows = [(None if i == 2 else i // 2, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "own", 3, b"x") for i, t in rows], "doc_id int, text string, groups_sha256 string, n_a int, counts binary")
    assert rows_of(align.align_documents(frame)) == expected(rows)
    assert align.align_documents(frame.limit(0)).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert rows_of(align.align_documents(only_bad)) == expected([(1, None), (2, "▁")])


def test_stretches_of_a_long_text_join_to_the_whole(monkeypatch):
    monkeypatch.setattr(align.stretches, "__defaults__", (50,))
    monkeypatch.setattr(align, "LEARNED_CHARS", 60)
    monkeypatch.setattr(align, "MEMO_PIECES", 3)
    text = "some words with ends, " * 40 + "y" * 300 + " and  more " * 30
    a, b, groups, links = plain(text)
    assert len(list(align.stretches(text))) > 10
    (found,) = align.align_texts(align.Aligner(OWN), [text], keep_groups=True)
    assert found.groups == written(groups) and found.numbers.tolist() == [len(a), len(b), len(groups), len(links)]
    assert found.digest == hashlib.sha256(written(groups).encode()).hexdigest()


def test_groups_can_be_had_as_text(spark):
    frame = spark.createDataFrame([(1, "Uncommon wordings align"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["groups"] for r in align.align(frame, A_PATH, B_PATH, with_groups=True).filter("counts is null").collect()}
    assert found == {1: written(plain("Uncommon wordings align")[2]), 2: ""}


def test_packed_pairs_come_back():
    for counts in ([1, 2, 255], [1, 300, 70000]):
        keys = np.array([0, 7, 4_000_000_000], np.uint32)
        back = align._unpacked(align._packed(keys, np.array(counts)))
        assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts


def test_highest_counts_and_their_ties_in_the_files(spark):
    rows = [(0, 1, 5), (0, 2, 5), (0, 3, 4), (2, 0, 9)]
    folder = align.write_pair_files(spark.createDataFrame(rows, "a int, b int, n_docs long"), 10)
    counts, best = align.PairFiles(folder, 10).find(np.array([20, 1, 3, 2], np.uint32))
    assert counts.tolist() == [9, 5, 4, 5] and best.tolist() == [1, 1, 0, 1]
