import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import chat
from netweave.llm.queries import QUERIES, ROUND_TRIP_TEXT

PIECES = ["\\", "###", "### ", "</turn>", " </turn>\n", " ", "\n", ":", ": ", "user", "a", "é", "<", "#", "/turn>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
@settings(max_examples=400, deadline=None)
def test_rendered_turns_read_back(turns):
    assert list(chat.parse("".join(chat.render(*turn)[0] for turn in turns))) == turns


def test_plain_text_is_not_escaped():
    assert chat.render("user", "plain text: # < fine") == ("### user: plain text: # < fine </turn>\n", 0)


def expected(rows):
    turns = defaultdict(list)
    for r in rows:
        turns[r["conv_id"]].append((r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = {}
    for conv_id, found in turns.items():
        found.sort()
        loss = "".join(text for *_, role, text in found if role == "assistant")
        out[conv_id] = (
            len(found), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in found).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def check(got, rows):
    want = expected(rows)
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    rows += [{"conv_id": -7, "turn": i, "role": r, "text": ROUND_TRIP_TEXT} for i, r in enumerate(("user", "assistant"))]
    check(QUERIES["op3_chat_round_trip"](spark, small).collect(), rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", None, 5), (1, None, None, "late", 5), (1, 1, "assistant", "b", 5), (1, 1, "assistant", "a", 5),
         (1, 1, "assistant", "a", 5), (None, 0, "assistant", "", 5), (2, 0, "a: b\n", "### x: y </turn>\n", 5)],
        "conv_id long, turn long, role string, text string, rendered int",
    )
    check(chat.format_conversations(frame).collect(), frame.collect())
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_one_conversation_longer_than_a_batch(spark):
    frame = spark.range(25_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    check(chat.format_conversations(frame).collect(), frame.collect())


def test_loss_spans_cut_the_learned_texts_out_of_the_formatted_text(spark, small):
    given_rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = [(-1, 0, "user", ROUND_TRIP_TEXT), (-1, 1, "assistant", ROUND_TRIP_TEXT), (-1, None, "assistant", None), (None, 3, "a:b\\#", "x"), (None, 3, "assistant", "é\U0001f600"), (-1, 1, "assistant", ROUND_TRIP_TEXT)]
    rows = given_rows.unionByName(spark.createDataFrame(hard, given_rows.schema))
    want = expected(rows.collect())
    turns = defaultdict(list)
    for r in chat.loss_spans(chat.format_turns(rows)).collect():
        turns[r["conv_id"]].append(r)
    assert turns.keys() == want.keys()
    for conv_id, found in turns.items():
        found.sort(key=lambda r: r["begin"])
        formatted = "".join(r["rendered"] for r in found)
        assert [r["begin"] for r in found] == [0, *[r["end"] for r in found]][:-1] and found[-1]["end"] == len(formatted)
        spans = [(r["loss_begin"], r["loss_end"], r) for r in found if r["loss_begin"] is not None]
        assert all((r["role"] == "assistant") == (r["loss_begin"] is not None) for r in found)
        learned = [text for role, text in chat.parse(formatted) if role == "assistant"]
        unescaped = [chat._read(formatted[a:b] + chat.CLOSE, 0, chat.MARK)[0] for a, b, _ in spans]
        assert unescaped == learned and hashlib.sha256("".join(learned).encode()).hexdigest() == want[conv_id][3]
