"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Two vocabularies cut the same bytes differently. Every token points to the farthest-right token that overlaps it,
of the other vocabulary or itself; following the pointers twice as far in each round, vectorised over all tokens
at hand, ends at the last token of the token's component. Tokens with one terminal token are a group: the
shortest stretches of both sides that cover the same bytes. Pairs of tokens that share bytes are links.

Neither vocabulary merges across a single space between two visible characters (the reader checks the piece
vocabulary for it), so a text is aligned in pieces cut there, and a piece that was met before is not aligned again. Pieces of
settled characters go through a faster reader of the first vocabulary, built from the same file; it merges in the same order.

1. Each split aligns its documents and writes, per document, counts, the digest of the groups and the distinct
   linked id pairs; and per some thousand documents how many of them hold each pair.
2. Spark adds the pair counts up. They become sorted files by the first vocabulary's ids: pair, count, and
   whether it is the highest of its first id. The product of the vocabulary sizes bounds them, whatever the corpus.
3. The stored documents look their pairs up in these files, one after the other, memory-mapped where the shared folder
   is mounted and else read.

Defined results: a null or empty text, and one whose bytes either vocabulary does not give back, has no tokens: zeros
and an empty digest. Repeated rows and null ids count and each get their row; extra columns do not matter; an
empty table gives an empty table. Long texts are aligned whole, stretch by stretch.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import file_exists, fresh_folder, local_fs, stored, write_file

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Where a text may be cut: a space between two characters that no tokenizer takes for white space.
BORDER = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
PLAIN, SPACE_SIGN = re.compile(r"[\w!-~]"), "▁"
#: Visible ends, and only characters whose class no version of Unicode has changed: what two readers of the first vocabulary cut alike.
SETTLED = re.compile(r"(?=[\w!-~])[ -~\n\xa1-\u024f]*(?<=[\w!-~])\Z")
# Fixed value: how byte-level vocabularies cut texts before they merge.
BYTE_LEVEL_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are aligned in stretches of about so many characters.
STRETCH = 1 << 20
#: A worker remembers at most about so many pieces (some 400 bytes each), and so many of their characters.
MEMO_PIECES, MEMO_CHARS = 500_000, 16 << 20
#: Pieces of texts of about so many characters are learned together.
LEARNED_CHARS = 1 << 19
#: Distinct pairs that a split collects before it hands their counts on.
PAIRS_HELD = 1 << 20
#: Files of counts: an id of the first vocabulary is in the file of its remainder, which spreads the common low ids.
FILES = 64
#: Documents looked up together.
LOOKED_UP = 2000

STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- vocabularies


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: visible ones for themselves, then from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and how ids are written in groups."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = _byte_alphabet()
        with open(first, encoding="utf-8") as f:
            given = json.load(f)
        names = {i: token for token, i in given["model"]["vocab"].items()}
        self.a_bytes = [bytes(alphabet[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.quick = _quick_reader(given, self.a_bytes)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on behind a space, so texts cannot be cut at spaces")
        self.b_bytes = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_lengths = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(b) for b in self.b_bytes], np.int64)
        #: whether settled characters come back from the second vocabulary as they were
        settled = "".join(chr(c) for c in range(0x250) if SETTLED.match(f"a{chr(c)}a"))
        self.faithful = b"".join(map(self.b_bytes.__getitem__, self.second.encode(settled))) == (" " + settled).encode()
        #: an id with what follows it: another id of its side, or the end of its side of the group
        self.written = [b"%d%s" % (i, end) for i in range(len(self.a_bytes)) for end in (b",", b"|")]
        self.written += [b"%d%s" % (i, end) for i in range(len(pieces)) for end in (b",", b";")]
        self.written_lengths = np.array([len(w) for w in self.written], np.int64)


def _quick_reader(given: dict, token_bytes: list[bytes]):
    """A faster reader of the same byte-level vocabulary; None where its ids are not in the order of its merges."""
    import tiktoken

    vocabulary, merges = given["model"]["vocab"], given["model"]["merges"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    reader = given["pre_tokenizer"] or {}
    in_order = all(vocabulary.get(token) == 256 + i for i, token in enumerate(joined))
    if not in_order or given["normalizer"] or reader.get("type") != "ByteLevel" or not reader.get("use_regex") or reader.get("add_prefix_space"):
        return None
    ranks = {token_bytes[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("first", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens={})


@cache
def vocabularies(first: str, second: str) -> Vocabularies:
    return Vocabularies(first, second)


# ---------------------------------------------------------------- groups and links


def terminal_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For the tokens of both sides, first side first, the number of the last token of their component.

    The ends are ascending byte offsets whose last ones agree. A second-side token that ends where a
    first-side token ends points to itself: nothing behind it overlaps.
    """
    n = len(a_ends)
    from_a = n + np.searchsorted(b_ends, a_ends)
    met = np.searchsorted(a_ends, b_ends)
    from_b = np.where(a_ends[met] > b_ends, met, n + np.arange(len(b_ends)))
    points_to = np.concatenate([from_a, from_b])
    while True:
        farther = points_to[points_to]
        if np.array_equal(farther, points_to):
            return points_to
        points_to = farther


def linked_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of overlapping tokens once, in order: the end of what they share, and their places on both sides."""
    ends = np.union1d(a_ends, b_ends)
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Aligner:
    """Aligns pieces of texts, remembering the latest."""

    def __init__(self, own: Vocabularies):
        self.own = own
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.numbers = np.zeros((1024, 4), np.int64)  # tokens of both sides, groups, links; zeros if not reversible
        self.groups: list[bytes] = []
        self.pairs: list[bytes] = []
        self.chars = 0

    def learn(self, pieces: Iterator[str]) -> None:
        """Align the pieces that are not remembered, all in one go but for those whose ends might join a neighbour."""
        if len(self.places) > MEMO_PIECES or self.chars > MEMO_CHARS:
            self.clear()
        missing = [p for p in dict.fromkeys(pieces) if p not in self.places]
        settled, plain, others = [], [], []
        quick_reader = self.own.quick is not None and self.own.faithful
        for piece in missing:
            if quick_reader and SETTLED.match(piece):
                settled.append(piece)
            elif PLAIN.match(piece) and PLAIN.match(piece, len(piece) - 1) and SPACE_SIGN not in piece:
                plain.append(piece)
            else:
                others.append(piece)
        for group, quick in ((settled, True), (plain, False)):
            if group and not self._align(group, quick):
                others += group
        for piece in others:
            if not self._align([piece]):
                self._remember([piece], np.zeros((1, 4), np.int64), [b""], [b""])

    def _remember(self, pieces: list[str], numbers: np.ndarray, groups: list[bytes], pairs: list[bytes]) -> None:
        first = len(self.groups)
        self.places.update(zip(pieces, range(first, first + len(pieces))))
        self.chars += sum(map(len, pieces))
        while len(self.numbers) < first + len(pieces):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[first : first + len(pieces)] = numbers
        self.groups += groups
        self.pairs += pairs

    def _align(self, pieces: list[str], quick: bool = False) -> bool:
        """False, and nothing remembered, if a vocabulary does not give the pieces' bytes back.

        Of settled characters, which the quick reader is for, that is known beforehand.
        """
        own, text = self.own, " ".join(pieces)
        given = (" " + text).encode("utf-8", "surrogatepass")
        a = own.quick.encode_ordinary(" " + text) if quick else own.first.encode(" " + text, add_special_tokens=False).ids
        b = own.second.encode(text, num_threads=1)
        if not quick and (b"".join(map(own.a_bytes.__getitem__, a)) != given or b"".join(map(own.b_bytes.__getitem__, b)) != given):
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(own.a_lengths[a]), np.cumsum(own.b_lengths[b])
        terminal = terminal_tokens(a_ends, b_ends)
        order = np.argsort(terminal, kind="stable")  # group by group, in each the first side first
        last = np.append(terminal[order][1:] != terminal[order][:-1], True)
        side = order >= len(a)
        last |= ~side & np.append(side[1:], True)
        codes = np.concatenate([a, len(own.a_bytes) + b])[order] * 2 + last
        written = b"".join(map(own.written.__getitem__, codes.tolist()))
        written_ends = np.concatenate([[0], np.cumsum(own.written_lengths[codes])])
        ends, a_at, b_at = linked_tokens(a_ends, b_ends)
        pairs = (a[a_at] * len(own.b_bytes) + b[b_at]).astype("<u4").tobytes()
        # where each piece ends: in bytes, and so in tokens of both sides, links and groups
        piece_ends = np.cumsum([1 + len(p) if p.isascii() else 1 + len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        a_to, b_to = np.searchsorted(a_ends, piece_ends) + 1, np.searchsorted(b_ends, piece_ends) + 1
        links_to = np.searchsorted(ends, piece_ends) + 1
        groups_to = np.concatenate([[0], np.cumsum(last & side)])[a_to + b_to]
        numbers = np.diff(np.stack([a_to, b_to, groups_to, links_to], axis=1), axis=0, prepend=0)
        text_to, links_to = [0, *written_ends[a_to + b_to].tolist()], [0, *(4 * links_to).tolist()]
        self._remember(
            pieces, numbers, [written[x:y] for x, y in zip(text_to, text_to[1:])], [pairs[x:y] for x, y in zip(links_to, links_to[1:])]
        )
        return True


@cache
def aligner_of(first: str, second: str) -> Aligner:
    """One for all tasks of a worker, so that what is remembered serves the next task, too."""
    return Aligner(vocabularies(first, second))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text without the spaces at which it is cut; each stretch ends at a border."""
    at = 0
    while len(text) - at > size and (found := BORDER.search(text, at + size)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(every), np.int64)
    np.add.at(sums, where, np.concatenate(counts))
    return every, sums


class Document:
    """What one text gives: numbers, the groups as bytes, distinct linked pairs and how often."""

    def __init__(self, keep_groups: bool = False):
        self.numbers = np.zeros(4, np.int64)
        self.sha = hashlib.sha256()
        self.kept: list[bytes] | None = [] if keep_groups else None
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.reversible = True

    def add(self, aligner: Aligner, pieces: list[str]) -> None:
        """The next stretch; its pieces are known to the aligner."""
        places = list(map(aligner.places.__getitem__, pieces))
        numbers = aligner.numbers[places]
        self.reversible &= bool(numbers[:, 0].all())
        if self.reversible:
            groups = (b";" if self.found else b"") + b"".join(map(aligner.groups.__getitem__, places))[:-1]
            self.numbers += numbers.sum(axis=0)
            self.sha.update(groups)
            if self.kept is not None:
                self.kept.append(groups)
            pairs = np.frombuffer(b"".join(map(aligner.pairs.__getitem__, places)), "<u4")
            self.found.append(np.unique(pairs, return_counts=True))

    def finish(self) -> Document:
        if not self.reversible:
            self.numbers[:] = 0
            self.found = []
        keys, counts = zip(*self.found) if self.found else ((np.zeros(0, np.uint32),), (np.zeros(0, np.int64),))
        self.keys, self.counts = (keys[0], counts[0]) if len(keys) == 1 else _added_up(keys, counts)
        self.digest = self.sha.hexdigest() if self.found else ""
        self.groups = b"".join(self.kept).decode() if self.kept and self.found else ""
        return self


def align_texts(aligner: Aligner, texts: list[str | None], keep_groups: bool = False) -> list[Document]:
    """Documents in order; the pieces of many texts are learned together."""
    found = [Document(keep_groups) for _ in texts]
    waiting: list[tuple[Document, list[str]]] = []
    size = 0

    def settle() -> None:
        aligner.learn(chain.from_iterable(pieces for _, pieces in waiting))
        for document, pieces in waiting:
            document.add(aligner, pieces)
        waiting.clear()

    for document, text in zip(found, texts):
        for part in stretches(text) if text else ():
            waiting.append((document, BORDER.split(part)))
            size += len(part)
            if size >= LEARNED_CHARS:
                settle()
                size = 0
    settle()
    return [d.finish() for d in found]


# ---------------------------------------------------------------- packed pairs


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending pairs as differences, byte plane by byte plane, and their counts."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    wide = "<u8" if len(counts) and counts.max() > 255 else "u1"
    body = zstandard.ZstdCompressor(level=1).compress(planes + counts.astype(wide).tobytes())
    return np.array([len(keys)], "<u4").tobytes() + body


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    steps = np.ascontiguousarray(body[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    counts = body[4 * n :]
    return np.cumsum(steps, dtype=np.uint32), (counts if len(counts) == n else counts.view("<u8")).astype(np.int64)


# ---------------------------------------------------------------- passes


def align(documents: DataFrame, first: str, second: str, with_groups: bool = False) -> DataFrame:
    """A row per document, and rows of pair counts, which have ``counts`` and nothing else.

    ``with_groups`` adds the groups themselves as text, ``a1,a2|b1;a3|b2,b3``.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(first, second)
        keys, counts, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(start, LOOKED_UP)
                found = align_texts(aligner, part.column("text").to_pylist(), with_groups)
                keys += [d.keys for d in found]
                held += sum(len(d.keys) for d in found)
                if held > PAIRS_HELD:
                    counts += [np.ones(len(k), np.int64) for k in keys[len(counts) :]]
                    own, sums = _added_up(keys, counts)
                    keys, counts, held = [own], [sums], 0
                    if len(own) > PAIRS_HELD:
                        yield _row_of_counts(own, sums, with_groups)
                        keys, counts = [], []
                yield _rows(part.column("doc_id"), found, with_groups)
        if keys:
            counts += [np.ones(len(k), np.int64) for k in keys[len(counts) :]]
            yield _row_of_counts(*_added_up(keys, counts), with_groups)

    schema = STORED + (", groups string" if with_groups else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, schema)


def _batch(columns: list, with_groups: bool) -> pa.RecordBatch:
    fields = [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]]
    fields += [("groups_sha256", pa.string()), ("pairs", pa.binary()), ("counts", pa.binary()), ("groups", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields][: len(columns)])


def _rows(ids: pa.Array, found: list[Document], with_groups: bool) -> pa.RecordBatch:
    numbers = np.array([d.numbers for d in found], np.int64).reshape(-1, 4).T
    columns = [ids, *numbers, [d.digest for d in found], [_packed(d.keys, d.counts) for d in found], [None] * len(found)]
    return _batch(columns + ([[d.groups for d in found]] if with_groups else []), with_groups)


def _row_of_counts(keys: np.ndarray, counts: np.ndarray, with_groups: bool) -> pa.RecordBatch:
    return _batch([[None], *[[None]] * 6, [_packed(keys, counts)], *([[None]] if with_groups else [])], with_groups)


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """(a, b, n_docs): in how many documents the first vocabulary's token a and the second's b share bytes."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                keys, counts = _unpacked(data.as_py())
                for at in range(0, len(keys), 1 << 16):
                    own = keys[at : at + (1 << 16)].astype(np.int64)
                    columns = [own // second_size, own % second_size, counts[at : at + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], ["a", "b", "n"])

    rows = aligned.filter("counts is not null").select("counts").mapInArrow(unpacked, "a int, b int, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def write_pair_files(counts: DataFrame, second_size: int) -> str:
    """Files of sorted pairs, all pairs of a first id in one: counts, pairs, and 1 where no pair of the id has more."""
    folder = fresh_folder(counts.sparkSession, "pair-counts")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64())]))
        a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n_docs"))
        for number in np.unique(a % FILES).tolist():
            own = np.flatnonzero(a % FILES == number)
            own = own[np.lexsort((b[own], a[own]))]
            starts = np.flatnonzero(np.diff(a[own], prepend=-1))
            most = np.repeat(np.maximum.reduceat(n[own], starts), np.diff(np.append(starts, len(own))))
            keys = (a[own] * second_size + b[own]).astype("<u4")
            write_file(folder, f"ids-{number}", [n[own].astype("<i8").tobytes(), keys.tobytes(), (n[own] == most).astype(np.uint8).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64())], ["n"])

    counts.repartition(FILES, F.col("a") % FILES).mapInArrow(written, "n long").agg(F.sum("n")).first()
    return folder


class PairFiles:
    """Look-ups in the files of ``write_pair_files``."""

    def __init__(self, folder: str, second_size: int):
        self.folder, self.second_size = folder, second_size

    @staticmethod
    def _bytes(folder: str, name: str) -> np.ndarray:
        fs, path = local_fs(folder)
        with (fs.open_input_file(f"{path}/{name}")) as f:
            if fs.type_name == "local":
                return np.memmap(f"{path}/{name}", np.uint8, "r")
            return np.frombuffer(f.read(), np.uint8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its count and whether it is among the highest of its first id."""
        by_file = (keys.astype(np.int64) // self.second_size % FILES << 32) + keys
        order = np.argsort(by_file)
        edges = np.searchsorted(by_file[order], np.arange(FILES + 1) << 32).tolist()
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for number, (at, to) in enumerate(zip(edges, edges[1:])):
            if to > at:
                if not file_exists(self.folder, f"ids-{number}"):
                    raise RuntimeError("a pair has no count")
                data = self._bytes(self.folder, f"ids-{number}")
                n = len(data) // 13
                place = np.searchsorted(data[8 * n : 12 * n].view("<u4"), keys[order[at:to]])
                counts[order[at:to]] = data[: 8 * n].view("<i8")[place]
                best[order[at:to]] = data[12 * n :][place]
        return counts, best


def with_corpus_counts(aligned: DataFrame, folder: str, second_size: int) -> DataFrame:
    """Per document, over its links: how many are their first id's most common pair, and the sum of the pairs' counts."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = PairFiles(folder, second_size)
        for whole in batches:
            for start in range(0, whole.num_rows, LOOKED_UP):
                batch = whole.slice(start, LOOKED_UP)
                found = [_unpacked(p.as_py()) for p in batch.column("pairs")]
                edges = np.cumsum([0, *[len(k) for k, _ in found]])
                times = np.concatenate([c for _, c in found])
                counts, best = files.find(np.concatenate([k for k, _ in found]))
                n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x * times)])[edges]) for x in (best, counts))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                columns = [*[batch.column(n) for n in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), batch.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "groups_sha256"])

    documents = aligned.filter("counts is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
    return documents.mapInArrow(looked_up, RESULT)


def align_documents(documents: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """A row per document: tokens, groups and links of both vocabularies, and the links against the whole corpus."""
    first, second = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)
    own = vocabularies(first, second)
    aligned = stored(align(documents, first, second), "aligned")
    folder = write_pair_files(pair_counts(aligned, len(own.b_bytes)), len(own.b_bytes))
    return with_corpus_counts(aligned, folder, len(own.b_bytes))
