"""Phrase collocations by top-order marginalisation: only the longest windows are counted, shorter phrases are sums.

1. Word counts per language give the frequent words, for no phrase is more frequent than its words. They get numbers:
   their places in sorted hash files in the shared folder, which workers map.
2. Lead columns put each word's followers beside it: windows of ``LONGEST`` words, padded where a piece ends or an infrequent
   word follows. Equal windows of a unit of text are one row, and rows go to ordered parts, whose borders a small sample
   of documents sets; since parts are cut between whole windows, no word or prefix is a hot key.
3. Within sorted rows a prefix stands in one stretch. A tail whose prefix is too rare becomes padding, unless the prefix
   may go on outside the stretch at hand; so sums over prefixes stay what they were, with few rows left.
4. Spark's ROLLUP over the window's columns sums the successively shorter prefixes: the counts of all phrases.
5. Each candidate meets the counts of its own inner phrases, is scored by its lowest cut with exact decimals, and goes if a
   longer candidate around it has nearly its count.

Defined results: null texts are empty; null languages are ``und`` and so one with texts marked ``und``. Repeated rows each
count. Order is total: score, count, then the phrase in UTF-8 order. Extra columns do not matter; an empty table gives an
empty table. Texts are read whole; a unit ends behind a text, so a very long text is a unit of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.llm.common import fresh_folder, give_back, local_fs, stored, write_file

LEAST, TOP, LONGEST = 30, 2000, 4
#: A candidate goes if a longer one around it has this share of its count, in hundredths.
ABSORBED = 80
#: Characters of text whose windows are added up before they leave a task; sorting them takes some 20 times as much memory.
UNIT_BYTES = 4 << 20
#: Words in one file of the dictionary, about.
FILE_WORDS = 1 << 20
#: Words of the documents that set the borders of the parts, about, and rows of a stretch of sorted windows.
SAMPLE_WORDS, STRETCH_ROWS = 1 << 20, 1 << 19

# What ends a piece; a full stop stands for all of it, as no word has one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = "."
PREPARED = bytes(c + 32 if 65 <= c <= 90 else 46 if c in PIECE_ENDS else 32 if c == 9 else c for c in range(256))
LOW = np.int64(0xFFFFFFFF)


# ---------------------------------------------------------------- words of units


def split_words(texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
    """Each text's words, with breaks between pieces and texts, as numbers into a list of the different ones."""
    data = b" . ".join(texts).translate(PREPARED).replace(b".", b" . ").strip()
    if not data:
        return np.zeros(0, np.int64), []
    ends = np.array([0, len(data)], np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    found = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language, codes and words of a bounded stretch of documents."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            value = text.as_py() or b""
            held.setdefault(lang, []).append(value)
            size += len(value)
            if size >= UNIT_BYTES:
                for key, texts in held.items():
                    yield key, *split_words(texts)
                held, size = {}, 0
    for key, texts in held.items():
        yield key, *split_words(texts)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def count_words(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, n): the frequent words, and for each language one row without word that counts all its words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, found in _units(batches):
            counts = np.bincount(codes, minlength=len(found))
            real = np.array([w != BREAK for w in found], bool)
            names = pa.array([None, *(w for w in found if w != BREAK)], pa.string())
            sums = np.concatenate([[counts[real].sum()], counts[real]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array(sums, pa.int64())], ["lang", "word", "n"])
        give_back()

    rows = _documents(documents).mapInArrow(counted, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("word").isNull() | (F.col("n") >= least))


# ---------------------------------------------------------------- dictionary


def _names(lang: str, found: list[str]) -> np.ndarray:
    """128-bit names of a language's words, as pairs of numbers."""
    before = f"{len(lang)}:{lang}".encode("utf-8", "surrogatepass")
    digests = b"".join(xxhash.xxh3_128_digest(before + w.encode("utf-8", "surrogatepass")) for w in found)
    return np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)


@dataclass
class Dictionary:
    """Numbers from 1 for the frequent words, by the order of their names, in files by the names' first bits."""

    folder: str
    bits: int
    sizes: list[int]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[1], 1 + np.cumsum(self.sizes)]).astype(np.int64)

    def _file(self, kind: str, number: int, numbers: str = "u1") -> np.ndarray:
        """Mapped where the shared folder is mounted, else read; callers hold one file at a time."""
        fs, path = local_fs(self.folder)
        if fs.type_name == "local":
            return np.memmap(f"{path}/{kind}-{number}", np.uint8, "r").view(numbers)
        with fs.open_input_file(f"{path}/{kind}-{number}") as f:
            return np.frombuffer(f.read(), np.uint8).view(numbers)

    def numbers(self, lang: str, found: list[str]) -> np.ndarray:
        """The words' numbers, 0 for the infrequent ones."""
        out = np.zeros(len(found), np.int64)
        names, starts = _names(lang, found), self.starts
        order = np.argsort(names[:, 0], kind="stable")
        high, low = names[order].T
        edges = np.searchsorted(high, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else []
        for number, (a, b) in enumerate(zip([0, *edges], [*edges, len(high)])):
            if b > a and self.sizes[number]:
                n = self.sizes[number]
                data = self._file("names", number, "<u8")
                known_high, known_low = data[:n], data[n:]
                place = np.searchsorted(known_high, high[a:b])
                while True:  # names that agree in their first half stand side by side
                    here = np.minimum(place, n - 1)
                    same = (place < n) & (known_high[here] == high[a:b])
                    other = same & (known_low[here] != low[a:b])
                    if not other.any():
                        break
                    place = place + other
                out[order[a:b]] = np.where(same, starts[number] + place, 0)
        return out

    def entries(self, numbers: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Language, word and count of each number."""
        langs: list[bytes] = [b""] * len(numbers)
        found: list[bytes] = [b""] * len(numbers)
        counts, starts = np.zeros(len(numbers), np.int64), self.starts
        file_of = np.searchsorted(starts, numbers, side="right") - 1
        for number in np.unique(file_of).tolist():
            own = np.flatnonzero(file_of == number)
            places, n = numbers[own] - starts[number], self.sizes[number]
            table = self._file("words", number)
            head = table[: 8 * (3 * n + 1)].view("<i8")
            counts[own], ends = head[places], head[n:]
            text = table[8 * (3 * n + 1) :]
            for at, place in zip(own.tolist(), places.tolist()):
                a, b, c = ends[2 * place : 2 * place + 3].tolist()
                langs[at], found[at] = text[a:b].tobytes(), text[b:c].tobytes()
        return langs, found, counts


def number_words(frequent: DataFrame) -> Dictionary:
    """Write the files of the dictionary; the driver learns how many words each file has."""
    folder = fresh_folder(frequent.sparkSession, "dictionary")
    rows = frequent.filter("word is not null")
    bits = (rows.count() // FILE_WORDS).bit_length()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
            names = np.concatenate([_names(lang, [w]) for lang, w in zip(langs, found)]) if langs else np.zeros((0, 2), np.uint64)
            file_of = (names[:, 0] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(names), np.int32)
            columns = [pa.array(file_of, pa.int32()), pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("lang", "word", "n"))], ["file", "high", "low", "lang", "word", "n"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        file_of = table.column("file").to_numpy()
        for number in np.unique(file_of).tolist():
            own = table.filter(pa.array(file_of == number))
            high, low = (own.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            order = np.lexsort((low, high))
            langs, found = (own.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "word"))
            parts = [p for i in order.tolist() for p in (langs[i], found[i])]
            ends = np.cumsum([0, *map(len, parts)])
            write_file(folder, f"names-{number}", [high[order].astype("<u8").tobytes(), low[order].astype("<u8").tobytes()])
            counts = own.column("n").to_numpy()[order]
            write_file(folder, f"words-{number}", [counts.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), b"".join(parts)])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(order)], pa.int64())], ["file", "size"])

    filed = rows.mapInArrow(named, "file int, high long, low long, lang string, word string, n long")
    sizes = {r["file"]: r["size"] for r in filed.repartition(1 << bits, "file").mapInArrow(_not_empty(written), "file int, size long").collect()}
    return Dictionary(folder, bits, [sizes.get(i, 0) for i in range(1 << bits)])


def _not_empty(run: Callable) -> Callable:
    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        return run(found) if found else iter(())

    return guarded


# ---------------------------------------------------------------- windows


def lead_windows(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a sequence of word numbers, in order, and their counts; 0 pads and ends.

    A window is two numbers, each of two words: 32 bits for a word.
    """
    longer = np.concatenate([sequence, np.zeros(LONGEST - 1, np.int64)])
    leads = [longer[k : len(longer) - LONGEST + 1 + k] for k in range(LONGEST)]
    leads = [column[leads[0] > 0] for column in leads]
    for before, own in zip(leads, leads[1:]):
        own[before == 0] = 0
    first, second = leads[0] << 32 | leads[1], leads[2] << 32 | leads[3]
    return _added_up(first, second, np.ones(len(first), np.int64))


def _added_up(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(first):
        return first, second, n
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[starts], second[starts], np.add.reduceat(n[order], starts)


def _windows(documents: DataFrame, dictionary: Dictionary, part_of: Callable, every: int = 1) -> DataFrame:
    """part, first, second, n: the windows of each unit; ``every`` thins them for a sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, found in _units(batches):
            if not len(codes):
                continue
            columns = [c[::every] for c in lead_windows(dictionary.numbers(lang, found)[codes])]
            part = part_of(columns[0], columns[1])
            for at in range(0, len(part), 1 << 16):
                own = [pa.array(c[at : at + (1 << 16)], t) for c, t in zip((part, *columns), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(own, ["part", "first", "second", "n"])
            del columns, part
        give_back()

    return _documents(documents).mapInArrow(counted, "part int, first long, second long, n long")


def _part_finder(borders: list[tuple[int, int]]) -> Callable:
    """How many borders are not above each of some ascending windows."""

    def part_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        places = []
        for high, low in borders:
            a, b = np.searchsorted(first, high), np.searchsorted(first, high, side="right")
            places.append(a + np.searchsorted(second[a:b], low))
        return np.searchsorted(np.array(places, np.int64), np.arange(len(first)), side="right").astype(np.int32)

    return part_of


def _borders(documents: DataFrame, dictionary: Dictionary, words: int, parts: int) -> list[tuple[int, int]]:
    """Windows that cut all windows into parts of about one size. Any borders give the same counts."""
    some = documents.sample(min(1.0, SAMPLE_WORDS / max(words, 1)), seed=1)
    rows = _windows(some, dictionary, lambda first, second: np.zeros(len(first), np.int32), every=16)
    found = sorted((r["first"], r["second"]) for r in rows.select("first", "second").collect())  # about SAMPLE_WORDS / 16 rows
    return [found[len(found) * k // parts] for k in range(1, parts)] if found else []


# ---------------------------------------------------------------- rare tails


def pad_rare_tails(first: np.ndarray, second: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a sorted stretch, in which tails of prefixes that are too rare are padding.

    A prefix of the stretch's first or last window may go on outside and is left as it is.
    """
    first, second, n = _added_up(first, second, n)
    if not len(first):
        return first, second, n

    def kept(*columns: np.ndarray) -> np.ndarray:
        changes = np.zeros(len(first), bool)
        changes[0] = True
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changes)
        good = np.add.reduceat(n, starts) >= least
        good[0] = good[-1] = True
        return np.repeat(good, np.diff(np.append(starts, len(first))))

    two, three, four = kept(first), kept(first, second >> 32), kept(first, second)
    second = np.where(two & three, np.where(four, second, second & ~LOW), 0)
    return _added_up(np.where(two, first, first & ~LOW), second, n)


def _padded(rows: DataFrame, least: int) -> DataFrame:
    """Windows in columns w1 to w4, sorted stretch by sorted stretch."""

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("first", "second", "n")])
            size += batch.num_rows
            if size >= STRETCH_ROWS:
                yield from _as_columns(held)
                held, size = [], 0
        if size:
            yield from _as_columns(held)
        held.clear()
        give_back()

    def _as_columns(held: list) -> Iterator[pa.RecordBatch]:
        first, second, n = pad_rare_tails(*(np.concatenate(c) for c in zip(*held)), least)
        columns = [first >> 32, first & LOW, second >> 32, second & LOW, n]
        for at in range(0, len(n), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in columns], ["w1", "w2", "w3", "w4", "n"])

    return rows.mapInArrow(collapsed, "w1 long, w2 long, w3 long, w4 long, n long")


# ---------------------------------------------------------------- phrases


def count_phrases(documents: DataFrame, dictionary: Dictionary, words: int, least: int = LEAST) -> DataFrame:
    """(first, second, size, f): the frequent phrases of one to ``LONGEST`` words and how often each occurs."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(documents, dictionary, words, parts)
    rows = _windows(documents, dictionary, _part_finder(borders))
    ordered = rows.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("first", "second")
    rolled = _padded(ordered, least).rollup("w1", "w2", "w3", "w4").agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    size = F.expr(f"{LONGEST} - bit_count(rolled)")
    last = F.get(F.array("w1", "w2", "w3", "w4"), F.col("size") - 1)
    whole = [F.coalesce(F.col(w), F.lit(0)) for w in ("w1", "w2", "w3", "w4")]
    found = rolled.withColumn("size", size.cast("int")).filter((F.col("f") >= least) & (F.col("size") > 0) & (last > 0))
    return found.select(_pair(whole[0], whole[1]).alias("first"), _pair(whole[2], whole[3]).alias("second"), "size", "f")


def _pair(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


#: Inner phrases of more than one word: from where, how many words.
INNER = {3: [(0, 2), (1, 2)], 4: [(0, 2), (1, 2), (2, 2), (0, 3), (1, 3)]}


def _inner_phrases(candidates: DataFrame) -> DataFrame:
    """A row for each inner phrase of a candidate: the phrase, which it is, and the candidate with its count."""
    high, low = (lambda c: F.shiftright(F.col(c), 32)), (lambda c: F.col(c).bitwiseAND(int(LOW)))
    w = [high("first"), low("first"), high("second"), low("second"), F.lit(0).cast("long")]

    def inner(start: int, size: int) -> Column:
        own = [*w[start : start + size], *[w[4]] * (4 - size)]
        return F.struct(_pair(own[0], own[1]).alias("first"), _pair(own[2], own[3]).alias("second"), F.lit(f"f{start}{size}").alias("which"))

    each = F.when(F.col("size") == 3, F.array(*[inner(*x) for x in INNER[3]])).when(F.col("size") == 4, F.array(*[inner(*x) for x in INNER[4]]))
    return candidates.select("first", "second", "f", F.explode(each).alias("inner")).select(
        "inner.*", F.col("first").alias("outer_first"), F.col("second").alias("outer_second"), F.col("f").alias("outer_f")
    )


def _with_inner_counts(phrases: DataFrame) -> DataFrame:
    """Candidates with the counts of their inner phrases and the highest count of a longer candidate around them."""
    names = [f"f{a}{b}" for a, b in INNER[4]]
    candidates = phrases.filter("size > 1")
    inner = _inner_phrases(candidates)
    met = inner.join(phrases.select("first", "second", "f"), ["first", "second"])
    none = F.lit(None).cast("long")
    own = candidates.select("first", "second", "size", F.col("f").alias("a"), none.alias("around"), *[none.alias(n) for n in names])
    around = inner.select("first", "second", F.lit(None).cast("int"), none, "outer_f", *[none] * len(names))
    below = met.select("outer_first", "outer_second", F.lit(None).cast("int"), none, none, *[F.when(F.col("which") == n, F.col("f")) for n in names])
    every = own.union(around).union(below)
    return every.groupBy("first", "second").agg(*[F.max(c).alias(c) for c in ("size", "a", "around", *names)])


def _named(candidates: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Candidates with language, phrase and the counts of their first and last words."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, size = (batch.column(c).to_numpy() for c in ("first", "second", "size"))
            numbers = np.stack([first >> 32, first & LOW, second >> 32, second & LOW])
            every, place = np.unique(numbers, return_inverse=True)
            real = every > 0
            langs, found, counts = dictionary.entries(every[real])
            shift = int((~real).sum())
            place = place.reshape(numbers.shape) - shift
            counts = np.append(counts, 0)
            last = place[np.maximum(size, 1) - 1, np.arange(len(size))]
            phrases = [b" ".join(found[p] for p in column[:n]) for column, n in zip(place.T.tolist(), size.tolist())]
            columns = [pa.array([langs[p] for p in place[0].tolist()], pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())]
            columns += [pa.array(counts[place[0]], pa.int64()), pa.array(counts[last], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang", "phrase", "first_n", "last_n"])

    schema = candidates.schema.simpleString()[len("struct<") : -1].replace(",", ", ")
    return candidates.mapInArrow(named, ", ".join(f.replace(":", " ") for f in schema.split(", ")) + ", lang string, phrase string, first_n long, last_n long")


def _lowest_cut() -> Column:
    """The cut of lowest score, the first of equal ones: score, k, l, r. Products are decimals, quotients at most a million."""

    def cut(k: int, left: str, right: str) -> Column:
        score = F.expr(f"cast((cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast({left} as decimal(20, 0)) + cast({right} as decimal(20, 0))) as long)")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    of_two = cut(1, "first_n", "last_n")
    of_three = F.least(cut(1, "first_n", "f12"), cut(2, "f02", "last_n"))
    of_four = F.least(cut(1, "first_n", "f13"), cut(2, "f02", "f22"), cut(3, "f03", "last_n"))
    return F.when(F.col("size") == 2, of_two).when(F.col("size") == 3, of_three).otherwise(of_four)


def mine_collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent = stored(count_words(documents, least), "frequent-words")
    totals = frequent.filter("word is null").select("lang", "n")
    dictionary = number_words(frequent)
    words = totals.agg(F.sum("n")).first()[0] or 0
    phrases = stored(count_phrases(documents, dictionary, words, least), "phrases")
    found = _with_inner_counts(phrases)
    alone = found.filter(F.col("around").isNull() | (100 * F.col("around") < ABSORBED * F.col("a")))
    scored = _named(alone, dictionary).withColumn("cut", _lowest_cut()).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    first = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH documents_lowered AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents_lowered),
sequences AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM sequences WHERE len(ws) > 0),
grams AS (SELECT lang, len(ws) AS n_ws, ws, i, unnest([1, 2, 3, 4]) AS size FROM starts),
counted AS (
    SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, ws[i:i + size - 1] AS p, count(*) AS f
    FROM grams WHERE i + size - 1 <= n_ws GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= 30),
candidates AS (SELECT * FROM frequent WHERE size > 1),
inner_phrases AS (
    SELECT lang, f, size, p, unnest(range(1, size)) AS start FROM candidates WHERE size > 2),
inner_sized AS (
    SELECT lang, f, array_to_string(p[start:start + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(2, size)) AS n FROM inner_phrases) WHERE start + n - 1 <= size),
around AS (SELECT lang, phrase, max(f) AS f FROM inner_sized GROUP BY lang, phrase),
alone AS (
    SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
    WHERE o.f IS NULL OR 100 * o.f < 80 * c.f),
cuts AS (
    SELECT lang, phrase, f, k, array_to_string(p[1:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, size)) AS k FROM alone)),
scored AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
    FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.x JOIN frequent r ON r.lang = c.lang AND r.phrase = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
