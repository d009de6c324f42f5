"""BPE encoding and decoding with content-defined chunks that are encoded once.

A rolling hash over the bytes cuts each text into chunks, so copies and shared passages give the
same chunks wherever they stand. A first pass counts the chunks of the whole corpus; a
chunk that occurs more than once is encoded once, and the result is handed to the splits
that hold it, as one memory-mapped file per split. The second pass takes shared chunks
from there, encodes the others, and repairs each join: the stretch between the last space
before a cut and the first space after it is encoded anew, and checked in a window that is a word
wider on both sides; if its tokens did not agree, the window would become the whole text.

A cut never changes a result: what is missing from a split's file is encoded in place.
Stretches of many texts are encoded together: each of their words once, by the pieces that the vocabulary's reader cuts it
into, which a worker remembers, see ``MEMO_WORDS``. Words of settled characters are cut here, and the library's model merges
their unknown pieces; the library reads all other words whole, as it does the windows around the joins.

Defined results: null texts count as empty and have no tokens; repeated rows and null ids
each get their row; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from netweave.llm.common import file_exists, fresh_folder, give_back, mapped_file, write_file

VOCABULARY = "word_bpe_49k.json"
#: A cut every so many bytes on average, and none closer than the second number.
MEAN_CHUNK = 1024
MIN_CHUNK = 128
#: Bytes over which the rolling hash looks.
ROLLING = 32
#: Texts whose chunks are added up before they leave a task, chunks that are encoded by one task.
UNIT_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20
#: Rows encoded at once, or so many bytes of their texts, or one longer text; windows that the library reads at once.
ROWS_AT_ONCE, BYTES_AT_ONCE, WINDOWS_AT_ONCE = 1000, 1 << 19, 200
#: A worker remembers its last one to two times so many different pieces, and as many words that the library reads, or so many characters of them.
MEMO_WORDS, MEMO_SIZE = 150_000, 16 << 20
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
# How the vocabulary's reader prepares and cuts texts before it merges.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
READERS = [
    {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: What a byte of a small settled word belongs to: letters (1), digits (2), which stand alone, or signs (0).
KINDS = np.array([1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 0 for b in range(256)], np.uint8)
#: Visible characters, but the apostrophe, that stand alone, have one small letter, and whose class no version of Unicode has changed.
SETTLED, SPECIAL = r"^[!-&(-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]*$", "<|"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- chunks


@cache
def _gear() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(text: bytes, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK) -> list[int]:
    """Where chunks begin, 0 first: places where the hash of the bytes before is small, moved to a character's start."""
    if len(text) <= least:
        return [0] if text else []
    codes = np.frombuffer(text, np.uint8)
    rolled, width, factor = _gear()[codes], 1, 0x9E3779B1
    while width < ROLLING:  # the hash of 2w bytes from those of w
        wider = rolled.copy()
        wider[width:] += rolled[:-width] * np.uint32(factor)
        rolled, width, factor = wider, 2 * width, factor * factor % (1 << 32)
    out = [0]
    for at in (np.flatnonzero(rolled < np.uint32((1 << 32) // mean)) + 1).tolist():
        while at < len(text) and codes[at] & 0xC0 == 0x80:
            at += 1
        if at - out[-1] >= least and at < len(text):
            out.append(at)
    return out


def chunks(text: bytes) -> list[bytes]:
    at = cuts(text)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def core(chunk: bytes) -> tuple[int, int] | None:
    """From the first space of a chunk to its last: what no neighbour can change."""
    first = SPACE.search(chunk)
    if first is None:
        return None
    last = max(chunk.rfind(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return first.start(), last + 1


# ---------------------------------------------------------------- encoding


class Memory:
    """The ids of what was met lately, and of the generation before."""

    def __init__(self):
        self.known: dict = {}
        self.older: dict = {}
        self.size = 0

    def missing(self, found: list) -> list:
        """What of ``found`` is not known; what the generation before knew is known again."""
        if len(self.known) > MEMO_WORDS or self.size > MEMO_SIZE:
            self.known, self.older, self.size = {}, self.known, 0
        out = []
        for one in set(found).difference(self.known):
            ids = self.older.get(one)
            if ids is None:
                out.append(one)
            else:
                self.known[one] = ids
            self.size += len(one)
        return out


class Encoder:
    """Texts to ids as little-endian 32-bit integers; each word is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = {i: token for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = pa.array([names.get(i, "") + " " for i in range(max(names) + 1)], pa.large_string())
        #: whether a token is the last of its piece
        self.last = np.array([names.get(i, "").endswith("</w>") for i in range(max(names) + 1)])
        self.words, self.pieces = Memory(), Memory()
        self.quick = _quick_reader(path, self.tokenizer)
        if self.quick is not None and not self._settled():
            self.quick = None

    def _settled(self) -> bool:
        """Whether the library reads settled characters, in all sorts of words, as they are cut here."""
        settled = [c for c in map(chr, range(33, 0x250)) if pc.match_substring_regex(c, SETTLED).as_py()]
        words = [w.encode() for c in settled for w in (c, f"a{c}{c}1{c}!{c}", f"'{c}s_{c}<")]
        return self.stretches(words) == self.windows(words)

    def ids(self, text: bytes) -> bytes:
        return self.stretches([text])[0]

    def stretches(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text: spaces separate what the merges look at, so the words' ids follow each other."""
        return [ids for some in _units(texts, BYTES_AT_ONCE) for ids in self._stretches(some)]

    def _stretches(self, texts: list[bytes]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        ends, ids = _joined(self._word_ids(words.dictionary).take(words.indices))
        at = ends[lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of different words."""
        mask = np.zeros(len(words), bool)
        if self.quick is not None:
            special = pc.match_substring(words, SPECIAL)
            mask = pc.and_not(pc.match_substring_regex(words, SETTLED), special).to_numpy(zero_copy_only=False)
        places = np.argsort(np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)]))
        both = [self._settled_ids(words.filter(pa.array(mask))), self._other_ids(words.filter(pa.array(~mask)))]
        return pa.concat_arrays(both).take(pa.array(places))

    def _settled_ids(self, words: pa.Array) -> pa.Array:
        words = pc.utf8_lower(words)
        starts, text = _joined(words)
        kinds = KINDS[np.frombuffer(text, np.uint8)]
        cut = np.ones(len(kinds) + 1, bool)
        cut[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        cut[starts] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
        found = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = self.pieces.missing(found)
        known = self.pieces.known
        if missing:
            ids = np.array(self.quick.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            packed = ids.tobytes()
            known.update(zip(missing, (packed[a:b] for a, b in zip(at, at[1:])), strict=True))
        merged = pa.array(map(known.__getitem__, found), pa.large_binary())
        ends, ids = _joined(merged.take(pieces.indices))
        at = pa.py_buffer(ends[np.searchsorted(cuts, starts)])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, at, pa.py_buffer(ids)])

    def _other_ids(self, words: pa.Array) -> pa.Array:
        found = words.to_numpy(zero_copy_only=False).tolist()
        missing = self.words.missing(found)
        known = self.words.known
        if missing:
            encoded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(missing, encoded))
        return pa.array(map(known.__getitem__, found), pa.large_binary())

    def whole(self, text: bytes) -> bytes:
        """The ids of a stretch by the tokenizer alone, without the memory of words."""
        return self.windows([text])[0]

    def windows(self, texts: list[bytes]) -> list[bytes]:
        """As ``whole``, of several stretches."""
        out = []
        for at in range(0, len(texts), WINDOWS_AT_ONCE):
            some = [t.decode() for t in texts[at : at + WINDOWS_AT_ONCE]]
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """What the library's decode gives without a decoder, in UTF-8: the tokens, special ones too, joined by spaces."""
        ends, joined = _joined(self.names.take(pa.array(np.frombuffer(b"".join(ids), "<u4"))))
        at = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [joined[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def _units(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in lists of bounded size."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where the values of a fresh array begin and end, and all of them in a row."""
    _, ends, joined = values.buffers()
    if not len(values):
        return np.zeros(1, np.int64), b""
    ends = np.frombuffer(ends, np.int64, len(values) + 1)
    return ends, joined[: int(ends[-1])].to_pybytes() if joined else b""


def _quick_reader(path: str, tokenizer: Tokenizer) -> Tokenizer | None:
    """The same merges for pieces between spaces; None where the vocabulary's reader is another or lacks bytes."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, vocabulary = given["model"], given["model"]["vocab"]
    alike = {"type": "BPE", "end_of_word_suffix": "</w>", "dropout": None, "unk_token": None, "continuing_subword_prefix": None}
    alphabet = pre_tokenizers.ByteLevel.alphabet()
    if (
        any(model.get(k) != v for k, v in alike.items())
        or model.get("ignore_merges")
        or given["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS}
        or given["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": READERS}
        or not all(t["content"].startswith("<|") and not t["normalized"] for t in given["added_tokens"])
        or not all(c + end in vocabulary for c in alphabet for end in ("", "</w>"))
    ):
        return None
    quick = Tokenizer(tokenizer.model)
    quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return quick


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _word_before(text: bytes, at: int) -> int:
    while at > 0 and text[at - 1 : at].isspace():
        at -= 1
    while at > 0 and not text[at - 1 : at].isspace():
        at -= 1
    return at


def _word_after(text: bytes, at: int) -> int:
    while at < len(text) and text[at : at + 1].isspace():
        at += 1
    while at < len(text) and not text[at : at + 1].isspace():
        at += 1
    return at


def encode_text(own: Encoder, text: bytes, shared: dict[bytes, bytes]) -> bytes:
    return encode_texts(own, [text], shared)[0]


def encode_texts(own: Encoder, texts: list[bytes], shared: dict[bytes, bytes]) -> list[bytes]:
    """The ids of whole texts from those of their chunks; ``shared`` has ids of chunk cores by digest."""
    #: of each text its ids or the numbers of stretches, in order, and of its joins the first of three stretches and the window
    plans, stretches = [], []

    def join(text: bytes, start: int, end: int, parts: list, joins: list) -> None:
        left, right = _word_before(text, start), _word_after(text, end)
        joins.append((len(stretches), text[left:right]))
        parts.append(len(stretches) + 1)
        stretches.extend((text[left:start], text[start:end], text[end:right]))

    for text in texts:
        parts, joins, open_from, at = [], [], 0, 0
        for chunk in chunks(text):
            inner = core(chunk)
            if inner is not None:
                if open_from < at + inner[0]:
                    join(text, open_from, at + inner[0], parts, joins)
                known = shared.get(digest(chunk)) if shared else None
                parts.append(len(stretches) if known is None else known)
                if known is None:
                    stretches.append(chunk[inner[0] : inner[1]])
                open_from = at + inner[1]
            at += len(chunk)
        if open_from < len(text):
            join(text, open_from, len(text), parts, joins)
        plans.append((text, parts, joins))

    ids, out = own.stretches(stretches), []
    read = iter(own.windows([window for _, _, joins in plans for _, window in joins]))
    for text, parts, joins in plans:
        # a window that does not agree makes the whole text the last window
        agree = [b"".join(ids[first : first + 3]) == next(read) for first, _ in joins]
        out.append(b"".join(ids[p] if isinstance(p, int) else p for p in parts) if all(agree) else own.whole(text))
    return out


# ---------------------------------------------------------------- passes over the corpus


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return ((value.as_py() or "").encode() for value in batch.column("text"))


def _pack(found: dict[bytes, list]) -> bytes:
    """Digests, counts and lengths, then the texts, compressed."""
    keys = b"".join(found)
    counts = np.array([n for n, _ in found.values()], "<u4").tobytes()
    lengths = np.array([len(t) for _, t in found.values()], "<u4").tobytes()
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in found.values()))
    return len(found).to_bytes(8, "little") + keys + counts + lengths + body


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    keys = np.frombuffer(blob, "V16", n, 8)
    counts = np.frombuffer(blob, "<u4", n, 8 + 16 * n)
    return keys, counts, np.frombuffer(blob, "<u4", n, 8 + 20 * n), blob[8 + 24 * n :]


def share_chunks(documents: DataFrame, path: str) -> str:
    """Encode each chunk that occurs more than once, once, and write one file for each split that holds some."""
    spark = documents.sparkSession
    folder = fresh_folder(spark, "bpe-chunks")
    size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TaskContext.get().partitionId()
        for texts in _units((text for batch in batches for text in _texts(batch)), UNIT_BYTES):
            dealt: list[dict[bytes, list]] = [{} for _ in range(buckets)]
            for text in texts:
                for chunk in chunks(text):
                    key = digest(chunk)
                    known = dealt[int.from_bytes(key[:4], "little") % buckets].setdefault(key, [0, chunk])
                    known[0] += 1
            full = [b for b in range(buckets) if dealt[b]]
            for b in full:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([split], pa.int32()), pa.array([_pack(dealt[b])], pa.binary())],
                    ["bucket", "split", "packed"],
                )
            del texts, dealt
        give_back()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for b, split, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "split", "packed"))):
                held.setdefault(b, []).append((split, packed))
        own = encoder(path)
        for b in sorted(held):
            found = [(split, *_unpack(packed)) for split, packed in held.pop(b)]
            keys = np.concatenate([f[1] for f in found])
            unique, where = np.unique(keys, return_inverse=True)
            common = np.bincount(where, np.concatenate([f[2] for f in found])) > 1
            ids: dict[int, bytes] = {}
            out: dict[int, list] = {}
            at = 0
            for split, some, _, lengths, body in found:
                own_places = where[at : at + len(some)]
                at += len(some)
                wanted = np.flatnonzero(common[own_places])
                if not len(wanted):
                    continue
                texts, ends = zstandard.ZstdDecompressor().decompress(body), np.cumsum(lengths.astype(np.int64))
                new: dict[int, bytes] = {}
                for i in wanted.tolist():
                    place = int(own_places[i])
                    if place not in ids and place not in new:
                        chunk = texts[ends[i] - lengths[i] : ends[i]]
                        inner = core(chunk)
                        new[place] = chunk[inner[0] : inner[1]] if inner else b""
                ids.update(zip(new, own.stretches(list(new.values()))))
                out.setdefault(split, []).extend((some[i].tobytes(), ids[int(own_places[i])]) for i in wanted.tolist())
            for split, pairs in out.items():
                body = b"".join(key + len(v).to_bytes(4, "little") for key, v in pairs) + b"".join(v for _, v in pairs)
                packed = zstandard.ZstdCompressor(level=3).compress(len(pairs).to_bytes(4, "little") + body)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split], pa.int32()), pa.array([packed], pa.binary())], ["split", "packed"]
                )
            found = ids = out = None
        give_back()

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for split, packed in zip(*(batch.column(c).to_pylist() for c in ("split", "packed"))):
                held.setdefault(split, []).append(packed)
        for split, parts in held.items():
            write_file(folder, f"split-{split}", [len(p).to_bytes(8, "little") + p for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    (
        documents.select("text").mapInArrow(gather, "bucket int, split int, packed binary")
        .repartition(buckets, "bucket").mapInArrow(encode, "split int, packed binary")
        .repartition(buckets, "split").mapInArrow(hand_out, "n long").agg(F.sum("n")).collect()
    )
    return folder


def _shared_ids(folder: str, split: int) -> dict[bytes, bytes]:
    """The ids of the chunks that this split shares, from its memory-mapped file."""
    if not folder or not file_exists(folder, f"split-{split}"):
        return {}
    data, at, out = mapped_file(folder, f"split-{split}"), 0, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 8].tobytes(), "little")
        body = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + n].tobytes())
        at += 8 + n
        count = int.from_bytes(body[:4], "little")
        value = 4 + 20 * count
        for i in range(count):
            key, length = body[4 + 20 * i : 20 + 20 * i], int.from_bytes(body[20 + 20 * i : 24 + 20 * i], "little")
            out[key] = body[value : value + length]
            value += length
    return out


def encode_documents(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: token count and digests of ids and decoded text; if asked for, the ids, 32 bits each, little-endian."""
    path = path or vocabulary_path()
    folder = share_chunks(documents, path)
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared = encoder(path), _shared_ids(folder, TaskContext.get().partitionId())
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in found for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            counts, hashes, decoded, all_ids = [], [], [], []
            for texts in _units(_texts(batch), BYTES_AT_ONCE):
                encoded = encode_texts(own, texts, shared)
                counts += [len(ids) // 4 for ids in encoded]
                hashes += [hashlib.sha256(ids).hexdigest() for ids in encoded]
                decoded += [hashlib.sha256(text).hexdigest() for text in own.decode(encoded)]
                if with_ids:
                    all_ids += encoded
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        shared.clear()
        give_back()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, schema)
