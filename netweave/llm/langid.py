"""Language ID: family first, then one-versus-one linear SVMs between the family's languages.

Texts become counts of hashed letter n-grams (two and three letters, word borders
included), damped and scaled to length one. One linear SVM per family against the rest picks
the family; inside it an SVM for each pair of languages votes, ties going to the larger
sum of margins. All are trained on a bounded sample of labelled documents that are not
held out; everything is predicted from whole texts alone.

Defined results: null texts and texts without a letter are ``und`` with score 0. A null
doc_id is not held out and never learned from. Repeated rows each get their row. If nothing
can be learned every text is ``und``; if one language is known every text with letters is
that language. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
DIMENSIONS = 4096
#: The classifiers are fitted on at most so many labelled documents, shared evenly by the languages.
SAMPLE_ROWS = 2000
EPOCHS = 25
PIECE = 1 << 20

#: Language families by ISO 639-1 code; other codes are a family of their own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str, piece: int = PIECE) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text; None without a letter.

    Pieces bound the memory: each goes on behind the last two codes of the one before, and only the text's ends are borders.
    """
    counts = np.zeros(DIMENSIONS, np.int64)
    text = text.lower()
    seen, after_letter, tail = False, True, np.array([32], np.uint32)
    for start in range(0, len(text), piece):
        codes = np.frombuffer(text[start : start + piece].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        seen |= bool(letter.any())
        # of characters that are no letters, one in a row stands for all
        kept = np.where(letter, codes, 32)[letter | np.concatenate([[after_letter], letter[:-1]])]
        end = [32] if start + piece >= len(text) else []
        row = np.concatenate([tail, kept, end]).astype(np.uint32)
        pairs = row[:-1] * np.uint32(0x9E3779B1) + row[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + row[2:] * np.uint32(0x27D4EB2F)
        counts += np.bincount(pairs[len(tail) - 1 :] * np.uint32(0x9E3779B1) >> np.uint32(20), minlength=DIMENSIONS)
        counts += np.bincount(triples * np.uint32(0x9E3779B1) >> np.uint32(20), minlength=DIMENSIONS)
        after_letter, tail = bool(letter[-1]), row[-2:]
    return counts if seen else None


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0) -> np.ndarray:
    """A linear SVM with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weights, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    norms = (x * x).sum(1) + 1 / (2 * c)
    generator = np.random.default_rng(11)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in generator.permutation(len(x)):
            gradient = y[i] * float(x[i] @ weights) - 1 + alpha[i] / (2 * c)
            step = max(alpha[i] - gradient / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights += np.float32(step * y[i]) * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    #: weights of each family against the rest, and of each pair (first is positive) inside a family
    rest: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNDETERMINED, 0.0
        x = np.append(x, np.float32(1))
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.rest @ x
            best = int(np.argmax(margins))
            others = np.delete(margins, best).max()
            family, score = self.families[best], _share(margins[best] - others)
        members = self.members[family]
        votes, sums, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
        for a, b in combinations(members, 2):
            margin = float(self.pairs[a, b] @ x)
            votes[a if margin >= 0 else b] += 1
            for lang, own in ((a, margin), (b, -margin)):
                sums[lang] += own
                sure[lang] = min(sure[lang], _share(2 * own))
        lang = max(members, key=lambda m: (votes[m], sums[m]))
        return lang, float(score * sure[lang])


def _share(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -20, 20))))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    found = np.array(langs, dtype=object)
    model = Model()
    for lang in sorted(set(langs)):
        model.members.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.members)
    own = np.array([family_of(lang) for lang in langs], dtype=object)
    if len(model.families) > 1:
        model.rest = np.stack([train_svm(x, np.where(own == name, 1.0, -1.0)) for name in model.families])
    for members in model.members.values():
        for a, b in combinations(members, 2):
            chosen = (found == a) | (found == b)
            model.pairs[a, b] = train_svm(x[chosen], np.where(found[chosen] == a, 1.0, -1.0))
    return model


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for order, lang, text in zip(batch.column("place"), batch.column("lang"), batch.column("text")):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                at = np.flatnonzero(counts)
                rows.append((order.as_py(), lang.as_py(), at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("place", "lang", "at", "counts"), row)) for row in rows],
            pa.schema([("place", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("counts", pa.binary())]),
        )


def learn(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of at most ``sample_rows`` labelled documents that are not held out."""
    rows = documents.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    totals = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model()
    each = max(1, sample_rows // len(totals))
    # a hash of the id is compared with the share of the language's rows that is wanted
    shares = F.create_map(*[F.lit(v) for lang, n in totals.items() for v in (lang, min(1.0, 1.3 * each / n + 20 / n))])
    place = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    sample = (
        rows.withColumn("place", place).filter(F.pmod("place", F.lit(1_000_003)) < shares[F.col("lang")] * 1_000_003)
        .select("place", "lang", "text").mapInArrow(_sample_batches, "place long, lang string, at binary, counts binary")
        .orderBy("place", "lang").limit(2 * sample_rows).collect()
    )
    taken, langs, x = dict.fromkeys(totals, 0), [], []
    for row in sample:
        if taken[row["lang"]] < each:
            taken[row["lang"]] += 1
            counts = np.zeros(DIMENSIONS, np.int64)
            counts[np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["counts"], "<u4")
            langs.append(row["lang"])
            x.append(unit(counts))
    return fit(np.array(x, np.float32).reshape(-1, DIMENSIONS), langs) if langs else Model()


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` replaced by id, language and score of each row's whole text."""
    send = documents.sparkSession.sparkContext.broadcast(model)  # a few weight vectors, whatever the input

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in found:
            langs, scores = [], []
            for text in batch.column("text"):
                counts = ngram_counts(text.as_py() or "")
                lang, score = (UNDETERMINED, 0.0) if counts is None else known.predict(unit(counts))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    kept = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return kept.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from ``documents`` and predict each of them."""
    return predict(documents, learn(documents, sample_rows))


def keep_identified(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` whose text has a language, all columns as they were."""
    model = learn(documents, sample_rows)
    send = documents.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in found:
            keep = []
            for text in batch.column("text"):
                counts = ngram_counts(text.as_py() or "")
                keep.append(counts is not None and known.predict(unit(counts))[0] != UNDETERMINED)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(batches, documents.schema)
