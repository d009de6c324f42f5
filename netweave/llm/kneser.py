"""Language-model scores: interpolated modified Kneser-Ney over word bigrams, counted in Spark.

The corpus is read in units: stretches of a split of bounded size. Three passes:

1. Each unit sends its distinct bigrams, as sorted hash arrays with their training counts, to hash ranges. A range
   adds the counts up and hands every unit the totals of its bigrams; of the units that hold a bigram the first
   owns it. Counts of counts give the discounts.
2. Each unit turns the bigrams it owns into continuation counts and follower counts of words. Again sorted hash
   arrays meet by hash range, are added up, and go back to the units that hold the words.
3. Each unit memory-maps its two files, the part of the model it needs, in the order of its
   sorted hashes, and scores its texts with array look-ups.

What a task holds is bounded by the unit or the hash range, whatever the corpus; a frequent word is one entry per
unit. The model's order is two: see the README for why.

Files are checked against the unit's own hashes, so a unit that read other texts than before stops
with an error and cannot score with foreign counts.

Defined results: null texts are empty; an empty text is one token, its end. A null doc_id is not held out and not
learned from. Repeated rows each count and each get their row. Without training texts all tokens are
equally likely. Extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import fresh_folder, mapped_file, write_file

UNIT_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
START, END = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b" ", b""))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def word_hashes(text: str | None) -> np.ndarray:
    found = (text or "").encode().translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Unit:
    """The tokens of some documents: for each token its word, the word before, and whether it is learned from."""

    def __init__(self, name: int, rows: list[tuple], texts: list[np.ndarray]):
        self.name, self.rows = name, rows
        sequence = np.concatenate([part for t in texts for part in ((START,), t, (END,))]).astype(np.uint64)
        self.words, place = np.unique(sequence, return_inverse=True)
        real = sequence[1:] != START
        self.before, self.word = place[:-1][real], place[1:][real]
        self.pairs = pair_hashes(sequence[:-1][real], sequence[1:][real])
        self.lengths = np.array([len(t) + 1 for t in texts])
        self.learned = np.repeat(np.array([r[2] for r in rows]), self.lengths)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    split, number, rows, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc_id, held_out, learned, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "learned", "text"))):
            value = text.as_py()
            rows.append((doc_id.as_py(), held_out.as_py(), learned.as_py()))
            texts.append(word_hashes(value))
            size += len(value or "") + 16
            if size >= UNIT_BYTES:
                yield Unit((split << 20) + number, rows, texts)
                number, rows, texts, size = number + 1, [], [], 0
    if rows:
        yield Unit((split << 20) + number, rows, texts)


# ---------------------------------------------------------------- sorted arrays as bytes


def _packed_counts(values: np.ndarray) -> bytes:
    data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<u4").tobytes())
    return len(data).to_bytes(8, "little") + data


def _packed_hashes(values: np.ndarray) -> bytes:
    """Differences of sorted hashes, six bytes each where they fit."""
    steps = np.diff(values, prepend=values[:1])
    wide = 8 if len(steps) and steps.max() >= np.uint64(1 << 48) else 6
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    return np.array([len(values), wide, values[0] if len(values) else 0], "<u8").tobytes() + body


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def hashes(self) -> np.ndarray:
        n, wide, first = (int(v) for v in np.frombuffer(self.data, "<u8", 3, self.at))
        steps = np.zeros((n, 8), np.uint8)
        steps[:, :wide] = np.frombuffer(self.data, np.uint8, n * wide, self.at + 24).reshape(n, wide)
        self.at += 24 + n * wide
        return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)

    def counts(self) -> np.ndarray:
        size = int.from_bytes(self.data[self.at : self.at + 8], "little")
        body = self.data[self.at + 8 : self.at + 8 + size]
        self.at += 8 + size
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<u4")


def _by_range(name: int, bits: int, hashes: np.ndarray, counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A unit's sorted hashes and counts, cut by the top bits of the hash."""
    edges = [0, *np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(hashes)] if bits else [0, len(hashes)]
    for r, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            packed = _packed_hashes(hashes[a:b]) + b"".join(_packed_counts(c[a:b]) for c in counts)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([name], pa.int64()), pa.array([packed], pa.binary())], ["range", "unit", "packed"])


RANGED = "range int, unit long, packed binary"


def _collected(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """All rows of one key at a time, from rows sorted by that key."""
    now, held = None, []
    for batch in batches:
        for r, u, packed in zip(*(batch.column(c) for c in ("range", "unit", "packed"))):
            own, other = (r.as_py(), u.as_py()) if key == "range" else (u.as_py(), r.as_py())
            if held and own != now:
                yield now, sorted(held)
                held = []
            now = own
            held.append((other, packed.as_py()))
    if held:
        yield now, sorted(held)


def _summed(parts: list[tuple[int, bytes]], columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The units' hash arrays, where each entry is among all, where each of all was first met, and the added counts."""
    readers = [_Reader(packed) for _, packed in parts]
    hashes = [r.hashes() for r in readers]
    counts = [[r.counts() for _ in range(columns)] for r in readers]
    every = np.concatenate(hashes)
    _, first, where = np.unique(every, return_index=True, return_inverse=True)
    sums = [np.bincount(where, np.concatenate([c[k] for c in counts])) for k in range(columns)]
    return hashes, where, first, sums


def _hand_back(r: int, parts: list[tuple[int, bytes]], hashes: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """To each unit the columns' values for its own entries, and a check of its hashes."""
    at = 0
    for (unit, _), own in zip(parts, hashes):
        check = xxhash.xxh3_64_digest(own.tobytes())
        packed = check + b"".join(_packed_counts(c[at : at + len(own)]) for c in columns)
        at += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([unit], pa.int64()), pa.array([packed], pa.binary())], ["range", "unit", "packed"])


def _stats(r: int, values: np.ndarray) -> pa.RecordBatch:
    """A row of sums for the driver, under a unit of its own."""
    packed = np.asarray(values, "<f8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([-1 - r], pa.int64()), pa.array([packed], pa.binary())], ["range", "unit", "packed"])


def _count_of_counts(values: np.ndarray) -> list[float]:
    return [float((values == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of entries counted 1 to 4 times."""
    if not min(n1, n2, n3, n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3)))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


# ---------------------------------------------------------------- the three passes


@dataclass
class Model:
    """Where the units' files are, and the numbers that all scores need."""

    folder: str
    bits: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    tokens: int  # N
    types: int  # V
    pairs: float  # distinct bigrams
    left_over: float  # what the discounts take from the continuation counts


def _exchange(rows: DataFrame, ranges: int, reduce, write) -> np.ndarray | None:
    """Units to hash ranges, ranges back to units, a file per unit; returns the added stats."""
    back = rows.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(reduce, RANGED)
    stats = back.repartition(ranges, "unit").sortWithinPartitions("unit").mapInArrow(write, "packed binary")
    found = [np.frombuffer(r["packed"], "<f8") for r in stats.collect()]  # one row of a few sums per range
    return np.sum(found, axis=0) if found else None


def _writer(folder: str, kind: str, columns: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, parts in _collected(batches, "unit"):
            if unit < 0:
                yield pa.RecordBatch.from_arrays([pa.array([parts[0][1]], pa.binary())], ["packed"])
                continue
            checks = b"".join(packed[:8] for _, packed in parts)
            readers = [_Reader(packed[8:]) for _, packed in parts]
            values = [[r.counts() for _ in range(columns)] for r in readers]
            write_file(folder, f"{kind}-{unit}", [len(parts).to_bytes(8, "little"), checks, *[np.concatenate([v[k] for v in values]).tobytes() for k in range(columns)]])

    return write


def _unit_file(model_folder: str, kind: str, unit: int, bits: int, hashes: np.ndarray, columns: int) -> np.ndarray:
    """The memory-mapped values of a unit's sorted hashes, one row per column."""
    data = mapped_file(model_folder, f"{kind}-{unit}")
    parts = int(data[:8].view("<u8")[0])
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
    slices = [hashes[a:b] for a, b in zip([0, *edges], [*edges, len(hashes)]) if b > a]
    checks = b"".join(xxhash.xxh3_64_digest(s.tobytes()) for s in slices)
    if checks != data[8 : 8 + 8 * parts].tobytes():
        raise RuntimeError("a unit holds other texts than when it was counted; store the documents before scoring them")
    return data[8 + 8 * parts :].view("<u4").reshape(columns, len(hashes))


def fit(rows: DataFrame) -> Model:
    """``rows``: doc_id, held_out, learned, text. Counts learned texts; prepares the units of all texts."""
    folder = fresh_folder(rows.sparkSession, "kneser")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // RANGE_BYTES)).bit_length()
    ranges = 1 << bits

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            hashes, where = np.unique(unit.pairs, return_inverse=True)
            yield from _by_range(unit.name, bits, hashes, [np.bincount(where, unit.learned, len(hashes))])

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, parts in _collected(batches, "range"):
            hashes, where, first, (sums,) = _summed(parts, 1)
            owned = np.zeros(len(where), np.uint32)
            owned[first] = sums > 0  # units are in order, so that the first stays the first in every attempt
            yield from _hand_back(r, parts, hashes, [sums[where], owned])
            yield _stats(r, np.array(_count_of_counts(sums)))

    stats = _exchange(rows.mapInArrow(send_pairs, RANGED), ranges, add_pairs, _writer(folder, "pairs", 2))
    d = discounts(*stats) if stats is not None else (0.5, 0.75, 0.9)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            hashes, first = np.unique(unit.pairs, return_index=True)
            counts, owned = _unit_file(folder, "pairs", unit.name, bits, hashes, 2)
            own = first[owned > 0]
            classes = np.minimum(counts[owned > 0], 3)
            n = len(unit.words)
            columns = [
                np.bincount(unit.word[own], minlength=n), *[np.bincount(unit.before[own][classes == k], minlength=n) for k in (1, 2, 3)],
                np.bincount(unit.before[unit.learned], minlength=n), np.bincount(unit.word[unit.learned], minlength=n),
            ]
            yield from _by_range(unit.name, bits, unit.words, columns)

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, parts in _collected(batches, "range"):
            hashes, where, _, sums = _summed(parts, 6)
            follows, known = sums[0], sums[5]
            yield from _hand_back(r, parts, hashes, [s[where] for s in sums])
            more = [float((follows > 2).sum())]
            yield _stats(r, np.array([*_count_of_counts(follows), *more, follows.sum(), known.sum(), (known > 0).sum()]))

    stats = _exchange(rows.mapInArrow(send_words, RANGED), ranges, add_words, _writer(folder, "words", 6))
    if stats is None:
        return Model(folder, bits, d, d, 0, 0, 0.0, 0.0)
    n1, n2, n3, n4, more, pairs, tokens, types = stats
    e = discounts(n1, n2, n3, n4)
    return Model(folder, bits, d, e, int(tokens), int(types), pairs, e[0] * n1 + e[1] * n2 + e[2] * more)


def token_scores(model: Model, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: whether it is known, its base score, and log10 of its probability."""
    hashes, where = np.unique(unit.pairs, return_inverse=True)
    counts = _unit_file(model.folder, "pairs", unit.name, model.bits, hashes, 2)[0][where].astype(np.float64)
    follows, one, two, more, total, known = (c.astype(np.float64) for c in _unit_file(model.folder, "words", unit.name, model.bits, unit.words, 6))
    d = model.pair_discounts
    base = np.log10((known + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    even = 1.0 / (model.types + 1)
    lower = (_discounted(follows, model.word_discounts) + model.left_over * even) / model.pairs if model.pairs else np.full(len(known), even)
    seen = total > 0
    share = np.where(seen, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
    upper = _discounted(counts, d) / np.maximum(total, 1)[unit.before]
    score = np.log10(upper + share[unit.before] * lower[unit.word])
    return known[unit.word] > 0, base[unit.word], score


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of the rows the model was prepared for."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(found):
            starts = np.concatenate([[0], np.cumsum(unit.lengths)[:-1]])
            known, base, own = (np.add.reduceat(x, starts) for x in (t.astype(np.float64) for t in token_scores(model, unit)))
            columns = [
                [r[0] for r in unit.rows], [r[1] for r in unit.rows], unit.lengths, known.astype(np.int64),
                np.full(len(starts), model.tokens), base, own,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)

    return rows.mapInArrow(batches, SCHEMA)


def score_documents(documents: DataFrame, folds: int = 10) -> DataFrame:
    """Learn from the documents that are not held out and score all."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    rows = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.coalesce(fold != 0, F.lit(False)).alias("learned"), "text",
    )
    return score(rows, fit(rows))
