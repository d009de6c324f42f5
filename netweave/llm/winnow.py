"""Document fingerprints by winnowing: rolling hashes of word k-grams, the least of every window, with positions.

Each word is hashed once. The hash of a k-gram is the XOR of its words' hashes, shifted by their place, and is rolled
together from those of shorter grams; a window's least one is found from those of its two halves. So a word costs a
few array steps, whatever the lengths of gram and window.

Of each window of ``WINDOW`` consecutive k-gram hashes the least is chosen, the rightmost one where several are
least; each chosen position is kept once. Two texts that share a run of ``K + WINDOW - 1`` words share a
chosen hash: the run holds a whole window, and its choice depends on that window alone. The positions
say where the shared runs are.

Defined results: null counts as the empty text, whose fingerprint is empty. A text of fewer than
``K`` words has one k-gram, all its words. Two empty fingerprints are alike by 1, an empty and a
full one by 0. Repeated rows each get their row. In the order of documents, which runs by
falling doc_id, rows of one id stand by a hash of their text, and null ids come last, by that hash too.
Extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.search import constant_array, count_not_above
from netweave.llm.common import SPACES
from netweave.plans.once import computed_once

K = 5
WINDOW = 8
#: A band has so many rows, between the two, as give four bands for each shuffle partition.
LEAST_BAND, LARGEST_BAND = 1000, 100_000
#: Null ids are dealt to so many bands by the hash of their text.
NULL_BANDS = 64
TRIMMED = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(left: Column, right: Column, shift: int, join) -> Column:
    """Each entry of ``left`` with that of ``right`` which stands ``shift`` places on."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), join)


def _rolled(hashes: Column, k: int) -> Column:
    """Hashes of the k-grams: those of 2w words from two of w, those of w + 1 words from one of w and a word."""

    def wider(grams: Column, width: int, bits: str) -> Column:
        if not bits:
            return grams
        twice = _joined(grams, grams, width, lambda a, b: F.shiftleft(a, width).bitwiseXOR(b))
        if bits[0] == "0":
            return _let(twice, lambda g: wider(g, 2 * width, bits[1:]))
        more = _let(twice, lambda g: _joined(g, hashes, 2 * width, lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b)))
        return _let(more, lambda g: wider(g, 2 * width + 1, bits[1:]))

    return wider(hashes, 1, bin(k)[3:])


def _rightmost_least(a: Column, b: Column) -> Column:
    return F.when(b["hash"] <= a["hash"], b).otherwise(a)


def _chosen(marks: Column, window: int) -> Column:
    """The rightmost least mark of every window, each once; a list that is no longer than a window is one window."""

    def wider(found: Column, width: int) -> Column:
        if width == window:
            return F.filter(found, lambda m, i: (i == 0) | (m["position"] != F.get(found, i - 1)["position"]))
        shift = min(width, window - width)  # two stretches that cover the wider one
        return _let(_joined(found, found, shift, _rightmost_least), lambda f: wider(f, width + shift))

    whole = F.array(F.aggregate(marks, F.get(marks, F.lit(0)), _rightmost_least))
    return F.when(F.size(marks) <= window, whole).otherwise(wider(marks, 1))


def _marks_of(found: Column) -> Column:
    """Marks of a text's words, of which there is one at least."""
    short = F.array(F.xxhash64(found))
    grams = F.when(F.size(found) < K, short).otherwise(_let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: _rolled(h, K)))
    marks = _let(grams, lambda g: F.transform(g, lambda h, i: F.struct(i.alias("position"), h.alias("hash"))))
    return _let(marks, lambda m: _chosen(m, WINDOW))


def with_fingerprint(df: DataFrame, text: str, marks: str) -> DataFrame:
    """Add ``marks``: an array of (position, hash) structs, positions counted in words from 0."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(TRIMMED))
    own = F.when(trimmed != "", _let(F.split(trimmed, SPACES), _marks_of))
    return computed_once(df, **{marks: F.coalesce(own, F.array().cast("array<struct<position:int,hash:bigint>>"))})


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each row's whole text."""
    return with_fingerprint(documents.select(F.col("doc_id").cast("long"), "text"), "text", "marks").drop("text")


def hashes(marks: Column) -> Column:
    return F.transform(marks, lambda m: m["hash"])


def digest(marks: Column) -> Column:
    """The fingerprint as a string of fixed length; empty for an empty fingerprint."""
    joined = F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["position"].cast("string"), m["hash"].cast("string"))), ",")
    return F.when(F.size(marks) == 0, F.lit("")).otherwise(F.sha2(joined, 256))


def likeness(a: Column, b: Column) -> Column:
    """Shared among all different hashes of two fingerprints."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def _banded(documents: DataFrame, rows_per_band: int | None) -> DataFrame:
    """Bands of neighbouring ids of about equal size; higher bands have higher ids, null ids the negative bands."""
    base = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = base.count()
    if rows_per_band is None:
        tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_band = min(max(total // (4 * tasks), LEAST_BAND), LARGEST_BAND)
    shares = max(1, total // rows_per_band)
    cuts: list[int] = []
    if shares > 1:
        wanted = [i / shares for i in range(1, shares)]
        found = base.agg(F.percentile_approx("doc_id", wanted, 20 * shares)).first()[0]
        cuts = sorted(set(found or []))
    inside = count_not_above(constant_array(cuts, T.LongType()), len(cuts), F.col("doc_id"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    nulls = F.lit(-1) - F.shiftrightunsigned("text_hash", 64 - NULL_BANDS.bit_length() + 1).cast("int")
    return base.withColumn("band", F.when(F.col("doc_id").isNull(), nulls).otherwise(inside))


def compare_with_next(documents: DataFrame, rows_per_band: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last third replaced from the next document.

    Rows are dealt to bands of ids once; inside a band the next row is the following one. What the last
    row of a band needs is the first row of the next band: one row per band, joined by band.
    """
    rows = _banded(documents, rows_per_band)
    spark = documents.sparkSession
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("order"), F.col("text_hash"))).alias("first")
    tops = rows.groupBy("band").agg(first).select("band", "first.*").orderBy(F.desc("band")).collect()
    follows = [(tops[(i + 1) % len(tops)][0], top[0]) for i, top in enumerate(tops)]
    # one row of four numbers per band, of up to LARGEST_BAND rows each
    heads = spark.createDataFrame([tuple(t) for t in tops], "head_band int, head_order long, head_hash long").join(
        spark.createDataFrame(follows, "head_band int, before int"), "head_band"
    )
    is_head = (
        (F.col("band") == F.col("head_band")) & (F.col("text_hash") == F.col("head_hash"))
        & F.bitwise_not("doc_id").eqNullSafe(F.col("head_order"))
    )
    heads = rows.join(F.broadcast(heads), is_head).select(F.col("before").alias("band"), F.col("text").alias("head_text"))
    heads = with_fingerprint(heads.dropDuplicates(["band"]), "head_text", "head_marks")
    heads = heads.select("band", "head_text", hashes(F.col("head_marks")).alias("head_hashes"))

    rows = with_fingerprint(rows, "text", "marks")
    rows = rows.select(
        "doc_id", "band", "text_hash", "text", digest(F.col("marks")).alias("fingerprint"), hashes(F.col("marks")).alias("hashes")
    )
    by = Window.partitionBy("band").orderBy(F.col("doc_id").desc_nulls_last(), "text_hash")
    rows = rows.withColumns({"next_text": F.lead("text").over(by), "next_hashes": F.lead("hashes").over(by)})
    rows = rows.join(heads.hint("shuffle_merge"), "band", "left")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    following = F.coalesce("next_text", "head_text")
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "hashes",
        F.coalesce("next_hashes", "head_hashes").alias("next_hashes"),
        F.concat(F.substr("text", F.lit(1), n - cut), F.substr(following, F.lit(1), cut)).alias("edited"),
    )
    rows = with_fingerprint(rows, "edited", "edited_marks")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
