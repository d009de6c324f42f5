import random

from checks.compare import differences
from netweave.llm import lines
from netweave.llm.queries import ORACLES, QUERIES


def plain(rows, least=lines.MIN_CHARS):
    """Texts by brute force: all windows of a power-of-two number of lines that stood earlier."""
    blank = lambda line: not line.strip(lines.BLANKS)
    seen, out = set(), []
    own = {}
    for k, (doc_id, text) in enumerate(rows):
        own[k] = [(i, line) for i, line in enumerate((text or "").split("\n")) if not blank(line)]
    gone = {k: set() for k in own}
    length = 1
    while length <= max((len(v) for v in own.values()), default=0):
        seen = set()
        for k, found in own.items():
            for p in range(len(found) - length + 1):
                window = tuple(line for _, line in found[p : p + length])
                if window in seen and sum(len(line.strip(lines.BLANKS)) for line in window) >= least:
                    gone[k] |= set(range(p, p + length))
                seen.add(window)
        length *= 2
    for k, (doc_id, text) in enumerate(rows):
        drop, found = set(), own[k]
        for p in sorted(gone[k]):
            last = p - 1 in gone[k]
            drop |= set(range(found[p - 1][0] + 1 if last else found[p][0], found[p][0] + 1))
        kept = None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
        out.append((doc_id, kept, len(found), len(gone[k])))
    return out


def found(frame):
    return sorted((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in lines.dedupe_lines(frame).collect())


def test_runs_agree_with_brute_force(spark):
    generator = random.Random(4)
    stock = [f"line number {i} of the stock" for i in range(12)] + ["ab", "c", "", " ", "x y"]
    rows = [(i, "\n".join(generator.choice(stock) for _ in range(generator.randrange(14)))) for i in range(60)]
    rows += [(60 + i, "\n".join(f"passage line {j}" for j in range(i, 40))) for i in range(4)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(plain(rows))


def test_query_agrees_with_brute_force_and_sql(spark, small):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in QUERIES["op8_line_dedup"](spark, small).collect())
    assert got == plain(rows) and sum(r[3] for r in got) > 0
    assert differences(spark, small, QUERIES["op8_line_dedup"], ORACLES["op8_line_dedup"]) == []


def test_ranks_order_the_suffixes(spark):
    frame = spark.createDataFrame([(1, "bbbbbbbbbbb\naaaaaaaaaaa\nb"), (2, "bbbbbbbbbbb\naaaaaaaaaaa\nc"), (3, "aaaaaaaaaaa\nbbbbbbbbbbb")], "doc_id long, text string")
    levels = lines.suffix_ranks(frame)
    assert [level.count() for level in levels] == [6, 2]
    assert {(r["doc"], r["pos"]) for r in levels[1].collect()} == {(1, 0), (2, 0)}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    text = "a long enough line\n\nanother long enough line"
    frame = spark.createDataFrame(
        [(2, text, 1, 1), (2, text, 1, 1), (None, text, 1, 1), (5, None, 1, 1), (6, "", 1, 1), (7, "é" * 60_000, 1, 1)],
        "doc_id long, text string, rank int, n_lines int",
    )
    rows = lines.dedupe_lines(frame).collect()
    assert [(r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in sorted(rows, key=lambda r: (r["doc_id"] or 0, str(r["text"])))] == [
        (None, text, 2, 0), (2, "", 2, 2), (2, "", 2, 2), (5, None, 0, 0), (6, "", 0, 0), (7, "é" * 60_000, 1, 0)
    ]
    assert all(r["rank"] == 1 for r in rows)
    assert lines.dedupe_lines(frame.limit(0)).count() == 0
