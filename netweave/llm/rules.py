"""Quality rules: decision lists learned from labelled text statistics, applied as ordered Spark conditions.

Method: sequential covering. A rule is a conjunction of thresholds on text statistics. It
is grown on two thirds of the labelled documents by information gain, pruned on the rest,
and kept while it is precise enough on that rest. The list becomes one ``CASE WHEN``.

Defined results: a null text has no words. A document with few words or many repeated
windows fails before the list is asked. Repeated rows each get their own row. Labels that
are null, or of documents that are not there, are ignored. Without labels of both kinds
the list is empty and keeps what the base rules keep. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import SPACE_BYTES, stored

SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"
UPPER = bytes(range(65, 91))
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS)
#: At most so many labelled documents are learned from, the first by a hash of their id.
LABELLED_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9


def repeat_words(found: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more, the first included."""
    n = len(found)
    if n <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        ids = np.fromiter(map(hash, found), np.int64, n).astype(np.uint64)
        windows = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):  # equal windows have equal values; the converse is checked below
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    maybe = np.zeros(len(windows), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    places: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():
        places.setdefault(tuple(found[i : i + WINDOW]), []).append(i)
    edges = np.zeros(n + 1, np.int64)
    for starts in places.values():
        if len(starts) > 1:
            for i in starts:
                edges[i] += 1
                edges[i + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def count_text(text: bytes) -> tuple[int, ...]:
    found = text.split()
    solid = text.translate(None, SPACE_BYTES)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(found),
        len(solid.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(found),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, MARKS)),
        len(set(found)),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text((value.as_py() or "").encode()) for value in batch.column("text")]
        arrays = [pa.array(column, pa.int64()) for column in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", *COUNTS])


def text_counts(documents: DataFrame) -> DataFrame:
    """One row of counts per document row, over its whole text."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_batches, SCHEMA)


def ratios() -> dict[str, Column]:
    """The statistics that rules put thresholds on."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("n_distinct_words") / n,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        column = x[:, names.index(self.name)]
        return column >= self.value if self.above else column <= self.value

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.above else F.col(self.name) <= self.value


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for condition in rule:
        inside &= condition.holds(x, names)
    return inside


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            for value in np.unique(np.quantile(x[inside, j], np.linspace(0, 1, 41), method="nearest")):
                for above in (True, False):
                    hit = inside & (x[:, j] >= value if above else x[:, j] <= value)
                    p2, n2 = (hit & bad).sum(), (hit & ~bad).sum()
                    if p2 and (gain := p2 * (np.log2(p2 / (p2 + n2)) - before)) > best[0]:
                        best = (gain, Condition(name, above, float(value)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = covered(rule, x, names)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[Rule, float]:
    """The prefix of the rule with the best worth on unseen rows, and its precision there."""
    best: tuple[float, Rule, float] = (-2.0, rule, 0.0)
    for length in range(1, len(rule) + 1):
        inside = covered(rule[:length], x, names)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:length], p / (p + n) if p + n else 0.0)
    return best[1], best[2]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """An ordered list of rules for bad documents; rows are dealt to growing and pruning by their place."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    role = np.arange(len(x)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~role, left & role
        if not bad[grow].any() or bad[grow].all() or not bad[prune].any():
            break
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            break
        rule, precision = _prune(rule, x[prune], bad[prune], names)
        if precision < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~covered(rule, x, names)
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from labelled statistics. ``labelled_rows`` bounds what is brought to the driver."""
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    )
    names = list(ratios())
    # the chosen labels are at most labelled_rows rows of two numbers: small enough to send to every task
    rows = (
        stats.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *[c.alias(k) for k, c in ratios().items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(labelled_rows).collect()
    )
    if not rows:
        return []
    return learn(np.array([r[2:] for r in rows], float), np.array([r[1] == 0 for r in rows]), names)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered condition: the first rule that holds rejects, else the document stays."""
    out = None
    for rule in rules:
        inside = rule[0].column()
        for condition in rule[1:]:
            inside = inside & condition.column()
        out = F.when(inside, F.lit(False)) if out is None else out.when(inside, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def rule_text(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.name} {'>=' if c.above else '<='} {c.value:.6g}" for c in rule) for rule in rules]


def apply_rules(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Counts, base verdict and learned verdict per document row."""
    counts = stored(text_counts(documents), "text-counts")
    rules = learn_rules(counts, labels, labelled_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counts.withColumns(ratios()).withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
        .drop(*ratios())
    )
