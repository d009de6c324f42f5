import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import pii
from netweave.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, texts):
    """``texts`` by doc_id."""
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], r, want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


PIECE = st.sampled_from(["a@b.c", "x_y@d-e.fg.h", "@", ".", "..", "é", "\U0001f600", "1.2.3.4", "256.1.1.1", "00255.0.0.01", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-11112", "+1 (988) 555-2485", "+12", "-", " ", "  ", "12", "7", "+", "(", "a", "%", "\n", ".5", "@x.y"])


@given(st.lists(st.lists(PIECE, max_size=14).map("".join), min_size=150, max_size=250))
@settings(max_examples=2, deadline=None)
def _texts_agree(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pii.report(frame).collect(), dict(enumerate(texts)))


def test_base_spans_agree_with_plain_patterns(spark):
    _texts_agree(spark)


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op1_personal_data"](spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sum(r["n_email"] for r in rows) > 0


def test_candidates_are_added_where_the_labelers_agree(spark):
    texts = {i: f"word call me at +1 (988) 555-{1000 + i} or mail ab{i}@x.example.com from host 10.0.0.{i % 250} end" for i in range(200)}
    texts[300] = "please call phone 988 555-2485 today"
    texts[301] = "order no. 988 555-2485x and build 12 345-6789"
    texts[302] = "mail to jane (at) example (dot) com"
    rows = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    check(rows.values(), texts)
    assert rows[300]["spans"] == "phone:18:30" and rows[302]["spans"] == "email:8:35"
    assert rows[301]["spans"] == ""


def test_reliable_labelers_are_found():
    patterns = {(1, 1, 1, 1, 1): 80, (1, 1, -1, 1, 1): 20, (0, -1, 1, -1, -1): 40, (0, -1, -1, -1, -1): 60}
    share, chance = pii.expectation_maximisation(patterns)
    assert abs(share - 0.5) < 0.05
    assert chance[1][1][0] > 0.9 > chance[2][1][0] and pii.posterior((1, 1, 1, 1, 1), share, chance) > 0.99


def test_nulls_many_spans_and_empty_tables(spark):
    many = " ".join(f"a{i}@b.co" for i in range(1500))
    frame = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, many, 1), (2, many, 1), (3, "1" * 50_000, 1), (4, "a" * 50_000 + "@", 1)], "doc_id long, text string, base int")
    rows = pii.report(frame).collect()
    check(rows, {1: None, None: "", 2: many, 3: "1" * 50_000, 4: "a" * 50_000 + "@"})
    assert len(rows) == 6
    assert pii.report(frame.limit(0)).count() == 0
