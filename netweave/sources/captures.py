"""Capture files: which names are accepted, and libpcap and pcapng records as packet rows.

A capture file is a chain of records, each of which tells where the next one begins. Files are cut into pieces of
``piece_bytes`` at any byte. Each piece looks for its first record by itself: a place from which several headers in a row are
plausible; then it walks the headers up to its end. Whether that place was right shows when the pieces are put together: the
walk of the piece before must have ended there. Where it did not, the piece is walked once more from the place where it
did. So no task walks a whole file, and the packets are those of a serial walk, whatever the pieces.

The second pass decodes the pieces, all packets of a piece at once with array operations.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave.schemas import PACKET
from netweave.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPTURE_ENDING = "pcap"
PIECE_BYTES = 64 * 1024 * 1024
BATCH = 100_000
#: Packets are decoded so many bytes at once, about; so many neighbouring pieces go to one task.
DECODED_BYTES = 16 * 1024 * 1024
NEIGHBOURS = 64

# Fixed values of the libpcap file format: header sizes, magic numbers with their ticks per second.
FILE_HEADER, RECORD_HEADER = 24, 16
MAGIC_TICKS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}

# Fixed values of the pcapng format: block types, byte-order magic, option codes.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET_BLOCK = 0x0A0D0D0A, 1, 2, 3, 6
OTHER_BLOCKS = (4, 5, 10, 0x00000BAD, 0x40000BAD, 9)
ORDER_MAGIC = 0x1A2B3C4D
RESOLUTION, OFFSET = 9, 14

# Link types, per link type where the Ethernet type and the network layer stand, Ethernet types.
ETHERNET, RAW_IP, COOKED, COOKED_2 = 1, 101, 113, 276
TYPE_AND_BODY = {ETHERNET: (12, 14), COOKED: (14, 16), COOKED_2: (0, 20)}
RAW_LINKS = (RAW_IP, 12, 14, 228)
IPV4_TYPE, VLAN_TYPE = 0x0800, 0x8100

#: No record is longer; headers in a row that make a place plausible; seconds a record may be from the file's first one.
LONGEST, CHAIN, SPAN = 1 << 18, 6, 400 * 86_400

WALKED = (
    "path string, size long, number long, begin long, end long, reason string, first long, first_order string, "
    "exit long, exit_order string, broken long, blocks array<struct<at: long, data: binary>>"
)


def allowed_file(name: Column) -> Column:
    """The name has a dot and its last part is the capture ending, in any case."""
    ending = F.lower(F.substring_index(name, ".", -1))
    return (F.instr(name, ".") > 0) & (ending == CAPTURE_ENDING)


def _open(path: str):
    if path.startswith("file:"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


# ---------------------------------------------------------------- formats


@dataclass(frozen=True)
class Layout:
    """What the head of a file says: pcapng or not, byte order, ticks per second, link type, seconds of the first record."""

    blocks: bool
    order: str
    ticks: int = 0
    link: int = 0
    began: int | None = None

    @property
    def start(self) -> int:
        return 0 if self.blocks else FILE_HEADER


def layout_of(head: bytes) -> Layout | None:
    """None for another kind of file. ``head``: the first bytes, a record header more than the file header."""
    for order in ("<", ">"):
        if len(head) >= 12 and struct.unpack("<I", head[:4])[0] == SECTION and struct.unpack(order + "I", head[8:12])[0] == ORDER_MAGIC:
            return Layout(True, order)
        if len(head) >= FILE_HEADER and struct.unpack(order + "I", head[:4])[0] in MAGIC_TICKS:
            began = struct.unpack(order + "I", head[24:28])[0] if len(head) >= 28 else None
            link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
            return Layout(False, order, MAGIC_TICKS[struct.unpack(order + "I", head[:4])[0]], link, began)
    return None


class Source:
    """Bytes of a file by position, from one buffer that moves along."""

    def __init__(self, file, size: int, begin: int = 0, length: int = 1 << 20):
        self.file, self.size, self.length = file, size, length
        self.at, self.data = begin, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at a position; fewer at the end of the file."""
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, self.length))
        return self.data[at - self.at : at - self.at + n]


def _next_record(source: Source, at: int, layout: Layout, order: str) -> tuple[int, str] | None:
    """Where the record at ``at`` ends, and the byte order from there; None if the file breaks off or breaks here."""
    if not layout.blocks:
        head = source.bytes(at, RECORD_HEADER)
        if len(head) < RECORD_HEADER:
            return None
        to = at + RECORD_HEADER + struct.unpack(order + "I", head[8:12])[0]
        return (to, order) if to <= source.size else None
    head = source.bytes(at, 12)
    if len(head) < 12:
        return None
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        found = next((o for o in ("<", ">") if struct.unpack(o + "I", head[8:12])[0] == ORDER_MAGIC), None)
        if found is None:
            return None
        order = found
    length = struct.unpack(order + "I", head[4:8])[0]
    if length < 12 or length % 4 or at + length > source.size or source.bytes(at + length - 4, 4) != head[4:8]:
        return None
    return at + length, order


def _plausible(source: Source, at: int, layout: Layout, order: str) -> bool:
    """Whether a record may stand here, from its header alone."""
    head = source.bytes(at, RECORD_HEADER)
    if layout.blocks:
        kinds = (SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET_BLOCK, *OTHER_BLOCKS)
        return len(head) >= 12 and struct.unpack(order + "I", head[:4])[0] in kinds and _next_record(source, at, layout, order) is not None
    if len(head) < RECORD_HEADER:
        return False
    seconds, fraction, captured, whole = struct.unpack(order + "IIII", head)
    near = layout.began is None or abs(seconds - layout.began) <= SPAN
    return near and fraction < layout.ticks and captured <= min(whole, LONGEST)


def first_record(source: Source, begin: int, end: int, layout: Layout) -> int | None:
    """The first place from ``begin`` on, before ``end``, from which a chain of headers is plausible.

    Places are tried in the order in which array operations over the bytes leave them as possible.
    """
    for block in range(begin, min(end, begin + LONGEST + RECORD_HEADER), 1 << 16):
        data = source.bytes(block, min(1 << 16, end - block) + RECORD_HEADER)
        for at in (block + _possible(data, layout)).tolist():
            if at >= end:
                return None
            here, order = at, layout.order
            for _ in range(CHAIN):
                if not _plausible(source, here, layout, order) or (step := _next_record(source, here, layout, order)) is None:
                    break
                here, order = step
                if here == source.size:
                    return at
            else:
                return at
    return None


def _possible(data: bytes, layout: Layout) -> np.ndarray:
    """Places in ``data`` whose first numbers fit a header."""
    n = min(len(data) - RECORD_HEADER + 1, 1 << 16)
    if n <= 0:
        return np.zeros(0, np.int64)
    every = np.zeros(n + 12, np.uint32)  # the number that begins at each byte
    for i in range(4):
        own = every[i::4]
        own[:] = np.frombuffer(data, layout.order + "u4", len(own), i)
    number = [every[4 * k : 4 * k + n] for k in range(4)]
    if layout.blocks:
        kinds = [SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET_BLOCK, *OTHER_BLOCKS]
        fits = np.isin(number[0], np.array(kinds, np.uint32)) & (number[1] % 4 == 0) & (number[1] >= 12)
    else:
        fits = (number[1] < layout.ticks) & (number[2] <= number[3]) & (number[2] <= LONGEST)
        if layout.began is not None:
            fits &= np.abs(number[0].astype(np.int64) - layout.began) <= SPAN
    return np.flatnonzero(fits)


# ---------------------------------------------------------------- walking


class OpenFile:
    """The file last asked for and its layout; it stays open while pieces of it follow each other."""

    def __init__(self):
        self.path, self.file, self.layout = None, None, None

    def of(self, path: str) -> tuple:
        if path != self.path:
            self.close()
            self.path, self.file = path, _open(path)
            self.layout = layout_of(self.file.read(FILE_HEADER + 4))
        return self.file, self.layout

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file, self.layout = None, None, None


def _walk(piece, length: int, opened: OpenFile) -> dict:
    """Walk one piece; ``first`` given starts there, else the piece finds its own start."""
    out = {**{c: getattr(piece, c) for c in ("path", "size", "number", "begin", "end")}, "blocks": []}
    file, layout = opened.of(piece.path)
    if layout is None:
        return out | {"reason": "not_a_capture"}
    source = Source(file, piece.size, piece.begin, length)
    given = None if pd.isna(piece.first) else int(piece.first)
    at, order = given, layout.order if given is None else piece.first_order
    if given is None:
        at = layout.start if piece.number == 0 else first_record(source, piece.begin, piece.end, layout)
    if at is None:
        return out
    out |= {"first": at, "first_order": order}
    while at < piece.end:
        step = _next_record(source, at, layout, order)
        if step is None:
            return out | {"exit": piece.size, "exit_order": order, "broken": at}
        if layout.blocks and struct.unpack(step[1] + "I", source.bytes(at, 4))[0] in (SECTION, INTERFACE):
            out["blocks"].append({"at": at, "data": source.bytes(at, step[0] - at)})
        at, order = step
    return out | {"exit": at, "exit_order": order}


def _walk_pieces(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in WALKED.split(", ") if not c.startswith("data")]
    whole = ["size", "number", "begin", "end", "first", "exit", "broken"]
    opened = OpenFile()
    for batch in pieces:
        rows = [_walk(piece, min(int(piece.end - piece.begin) + 16, 1 << 22), opened) for piece in batch.itertuples()]
        frame = pd.DataFrame(rows, columns=names)
        frame[whole] = frame[whole].astype("Int64")
        yield frame.astype(dict.fromkeys(("path", "reason", "first_order", "exit_order", "blocks"), object))
    opened.close()


def _dealt(pieces: DataFrame, tasks: int) -> DataFrame:
    """Pieces dealt to so many tasks, which get stretches of neighbours; Spark would put many small rows into few tasks."""
    return pieces.repartition(tasks, "path", F.floor(F.col("number") / NEIGHBOURS)).sortWithinPartitions("path", "number")


def _tasks(files: DataFrame) -> int:
    """A task for every ``PIECE_BYTES`` of the files, and one for each core at least."""
    size = files.agg(F.sum("size")).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE_BYTES))


def _expected(walked: DataFrame) -> DataFrame:
    """Beside each piece where the pieces before it end, and in which byte order."""
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("exit").isNotNull(), F.struct("exit", "exit_order"))).over(before)
    return walked.withColumn("_reached", reached)


def find_pieces(spark: SparkSession, folder: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per piece of each accepted file: its first and last place, or why the file cannot be read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("size"))
        .filter(allowed_file(F.substring_index("path", "/", -1)))
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / piece_bytes) - 1, F.lit(0)).cast("long"))
    pieces = files.select("path", "size", F.explode(numbers).alias("number")).select(
        "*", (F.col("number") * piece_bytes).alias("begin"), F.least((F.col("number") + 1) * piece_bytes, F.col("size")).alias("end")
    )
    unknown = pieces.withColumns({"first": F.lit(None).cast("long"), "first_order": F.lit(None).cast("string")})
    walked = settled(_dealt(unknown, _tasks(files)).mapInPandas(_walk_pieces, WALKED), "capture-pieces")
    columns = walked.columns
    while True:
        met = _expected(walked)
        wrong = (
            F.col("_reached").isNotNull()
            & (F.col("_reached.exit") < F.col("end"))
            & ~F.struct("first", "first_order").eqNullSafe(F.struct(F.col("_reached.exit").alias("first"), F.col("_reached.exit_order").alias("first_order")))
        )
        # a piece whose predecessor was wrong itself may still turn out right, so only each file's first is certain
        earliest = F.min(F.when(wrong, F.col("number"))).over(Window.partitionBy("path"))
        todo = settled(met.withColumn("_redo", wrong & (F.col("number") == earliest)), "capture-starts")
        if todo.filter("_redo").isEmpty():
            return _within(todo)
        again = todo.filter("_redo").withColumns({"first": F.col("_reached.exit"), "first_order": F.col("_reached.exit_order")})
        redone = again.select("path", "size", "number", "begin", "end", "first", "first_order").repartition("path").mapInPandas(_walk_pieces, WALKED)
        walked = settled(todo.filter(~F.col("_redo")).select(*columns).unionByName(redone), "capture-pieces")


def _within(met: DataFrame) -> DataFrame:
    """A piece that lies inside a record, or behind the place where its file breaks, has nothing of its own."""
    passed = F.coalesce(F.col("_reached.exit") >= F.col("end"), F.lit(False))
    so_far = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    own = met.withColumns({c: F.when(~passed, F.col(c)) for c in ("first", "exit", "broken")} | {"blocks": F.when(~passed, F.col("blocks"))})
    return own.withColumn("blocks", F.flatten(F.collect_list("blocks").over(so_far))).drop("_reached", "_redo")


# ---------------------------------------------------------------- decoding


@dataclass
class Interface:
    """A pcapng interface: link type, the longest captured part, and how its time stamps count."""

    link: int
    longest: int
    resolution: int = 6
    offset: int = 0

    def micros(self, ticks: np.ndarray) -> np.ndarray:
        if self.resolution & 0x80:
            own = [int(t) * 1_000_000 >> (self.resolution & 0x7F) for t in ticks]
            micros = np.array(own, np.int64)
        elif self.resolution <= 6:
            micros = ticks.astype(np.int64) * 10 ** (6 - self.resolution)
        else:
            micros = (ticks // np.uint64(10 ** (self.resolution - 6))).astype(np.int64)
        return micros + self.offset * 1_000_000


def _interface(data: bytes, order: str) -> Interface:
    link, _, longest = struct.unpack(order + "HHI", data[8:16])
    found, at = Interface(link, longest or LONGEST), 16
    while at + 4 <= len(data) - 4:
        code, length = struct.unpack(order + "HH", data[at : at + 4])
        value = data[at + 4 : at + 4 + length]
        if code == 0:
            break
        if code == RESOLUTION and length == 1:
            found.resolution = value[0]
        elif code == OFFSET and length == 8:
            found.offset = struct.unpack(order + "q", value)[0]
        at += 4 + (length + 3) // 4 * 4
    return found


@dataclass
class Records:
    """Packets of a stretch: positions of record and data, captured length, time in microseconds or null, link type."""

    at: list[int] = field(default_factory=list)
    data: list[int] = field(default_factory=list)
    captured: list[int] = field(default_factory=list)
    ticks: list[int] = field(default_factory=list)
    source: list[Interface | None] = field(default_factory=list)

    def extend(self, other: Records, begin: int) -> None:
        """Take the other's packets, whose bytes begin at ``begin``."""
        self.at += other.at
        self.data += [begin + place for place in other.data]
        self.captured += other.captured
        self.ticks += other.ticks
        self.source += other.source

    def add(self, at: int, data: int, captured: int, ticks: int, source: Interface | None) -> None:
        for values, value in zip((self.at, self.data, self.captured, self.ticks, self.source), (at, data, captured, ticks, source)):
            values.append(value)


def _records(data: bytes, piece, layout: Layout) -> Iterator[Records]:
    """The packets between the piece's first and last place; ``data`` begins at the first place."""
    found, order, at = Records(), piece.first_order, 0
    whole = Interface(layout.link, LONGEST, 6 if layout.ticks == 1_000_000 else 9)
    interfaces: list[Interface] = []
    known = sorted((b["at"], b["data"]) for b in piece.blocks if b["at"] < piece.first)
    stop = int(piece.exit if pd.isna(piece.broken) else piece.broken) - int(piece.first)
    for _, block in known:
        order_of = _note_block(block, interfaces, None)
    if known:
        order = order_of
    while at < stop:
        if len(found.at) >= BATCH:
            yield found
            found = Records()
        if not layout.blocks:
            seconds, fraction, captured = struct.unpack_from(order + "III", data, at)
            found.add(piece.first + at, at + RECORD_HEADER, captured, seconds * layout.ticks + fraction, whole)
            at += RECORD_HEADER + captured
            continue
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if struct.unpack_from("<I", data, at + 8)[0] == ORDER_MAGIC else ">"
        kind, length = struct.unpack_from(order + "II", data, at)
        if kind in (SECTION, INTERFACE):
            _note_block(data[at : at + length], interfaces, order)
        elif kind in (PACKET_BLOCK, OLD_PACKET) and length >= 32:
            number = struct.unpack_from(order + ("I" if kind == PACKET_BLOCK else "H"), data, at + 8)[0]
            high, low, captured = struct.unpack_from(order + "III", data, at + 12)
            if number < len(interfaces):
                found.add(piece.first + at, at + 28, min(captured, length - 32), high << 32 | low, interfaces[number])
        elif kind == SIMPLE_PACKET and length >= 16 and interfaces:
            original = struct.unpack_from(order + "I", data, at + 8)[0]
            found.add(piece.first + at, at + 12, min(original, interfaces[0].longest, length - 16), -1, interfaces[0])
        at += length
    if found.at:
        yield found


def _note_block(block: bytes, interfaces: list[Interface], order: str | None) -> str:
    """Take a section or interface block into account; a section begins with no interfaces."""
    if block[:4] == b"\x0a\x0d\x0d\x0a":
        interfaces.clear()
        return "<" if struct.unpack("<I", block[8:12])[0] == ORDER_MAGIC else ">"
    own = order or ("<" if struct.unpack("<I", block[:4])[0] == INTERFACE else ">")
    interfaces.append(_interface(block, own))
    return own


def _fields(data: bytes, found: Records) -> dict[str, np.ndarray]:
    """IPv4, TCP and UDP header fields of all packets; masked where a packet has no such header."""
    bytes_ = np.frombuffer(data + bytes(64), np.uint8)
    start, captured = np.array(found.data, np.int64), np.array(found.captured, np.int64)
    link = np.array([s.link for s in found.source], np.int64)

    def number(at: np.ndarray, size: int) -> np.ndarray:
        """Big-endian numbers at positions within the packets; nonsense outside, which the masks cover."""
        place = np.minimum(start + at, len(bytes_) - 8)
        return sum(bytes_[place + i].astype(np.int64) << (8 * (size - 1 - i)) for i in range(size))

    ip = np.zeros(len(start), np.int64)
    usable = np.isin(link, RAW_LINKS)
    for kind, (type_at, body) in TYPE_AND_BODY.items():
        own = link == kind
        ether = number(np.full(len(start), type_at), 2)
        tagged = own & (ether == VLAN_TYPE) & (kind == ETHERNET)
        ether = np.where(tagged, number(np.full(len(start), type_at + 4), 2), ether)
        ip = np.where(own, body + 4 * tagged, ip)
        usable |= own & (ether == IPV4_TYPE)
    usable &= (captured >= ip + 20) & (number(ip, 1) >> 4 == 4)
    words, flags, proto = number(ip, 1) & 15, number(ip + 6, 2), number(ip + 9, 1)
    body = ip + np.maximum(words, 5) * 4
    whole = usable & (flags & 0x1FFF == 0)  # a later fragment has no transport header
    tcp, udp = whole & (proto == 6) & (captured >= body + 16), whole & (proto == 17) & (captured >= body + 6)

    def address(at: int) -> np.ndarray:
        parts = [number(ip + at + i, 1).astype(str) for i in range(4)]
        text = parts[0]
        for part in parts[1:]:
            text = np.char.add(np.char.add(text, "."), part)
        return np.where(usable, text.astype(object), None)

    def masked(values: np.ndarray, where: np.ndarray) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(values.astype(np.int32), ~where)

    return {
        "src_ip": address(12), "dst_ip": address(16), "ip_len": masked(number(ip + 2, 2), usable), "ihl": masked(words, usable),
        "ip_flags": masked(flags >> 13, usable), "ttl": masked(number(ip + 8, 1), usable), "proto": masked(proto, usable),
        "src_port": masked(number(body, 2), tcp | udp), "dst_port": masked(number(body + 2, 2), tcp | udp),
        "tcp_flags": masked(number(body + 13, 1), tcp), "tcp_window": masked(number(body + 14, 2), tcp), "udp_len": masked(number(body + 4, 2), udp),
    }


def _times(found: Records) -> pd.Series:
    ticks = np.array([max(t, 0) for t in found.ticks], np.uint64)
    micros = np.zeros(len(ticks), np.int64)
    kinds: dict[tuple[int, int], int] = {}
    kind = np.array([kinds.setdefault((s.resolution, s.offset), len(kinds)) for s in found.source])
    for (resolution, offset), number in kinds.items():
        here = kind == number
        micros[here] = Interface(0, 0, resolution, offset).micros(ticks[here])
    times = pd.Series(pd.to_datetime(micros, unit="us", utc=True))
    return times.mask(np.array([t < 0 for t in found.ticks]))


def _decoded(held: list[tuple[str, bytes, Records]]) -> pd.DataFrame:
    """The packets of some stretches of files, with array operations over all of them."""
    every, paths, begin = Records(), [], 0
    for path, data, found in held:
        every.extend(found, begin)
        paths += [path] * len(found.at)
        begin += len(data)
    fixed = {"packet_id": every.at, "sensor_id": paths, "ts": _times(every), "packet_size": np.array(every.captured, np.int32)}
    frame = pd.DataFrame({**fixed, **_fields(b"".join(data for _, data, _ in held), every)})
    return frame[PACKET.fieldNames()].astype(dict.fromkeys(("sensor_id", "src_ip", "dst_ip"), object))


def _decode_pieces(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened, held, packets, size = OpenFile(), [], 0, 0
    for batch in pieces:
        for piece in batch.itertuples():
            file, layout = opened.of(piece.path)
            file.seek(int(piece.first))
            data = file.read(int(piece.exit - piece.first))
            for found in _records(data, piece, layout):
                held.append((piece.path, data, found))
                packets, size = packets + len(found.at), size + len(data)
                if packets >= BATCH or size >= DECODED_BYTES:
                    yield _decoded(held)
                    held, packets, size = [], 0, 0
    if held:
        yield _decoded(held)
    opened.close()


# ---------------------------------------------------------------- readers


def decode_pieces(pieces: DataFrame) -> DataFrame:
    own = pieces.filter("reason is null and first is not null and first < exit")
    files = pieces.filter("number = 0").select("path", "size")
    needed = own.select("path", "number", "first", "first_order", "exit", "broken", "blocks")
    return _dealt(needed, _tasks(files)).mapInPandas(_decode_pieces, PACKET)


def rejected_files(pieces: DataFrame) -> DataFrame:
    """path, reason, position: files that are no capture, and those that break off or break at a position."""
    no_capture = pieces.filter("reason is not null and number = 0").select("path", "reason", F.lit(0).cast("long").alias("position"))
    broken = pieces.filter("broken is not null").select("path", F.lit("cut_off").alias("reason"), F.col("broken").alias("position"))
    return no_capture.unionByName(broken)


def open_captures(spark: SparkSession, folder: str, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Packets of all accepted files in a folder, and a row for each file that cannot be read or not to its end."""
    pieces = find_pieces(spark, folder, piece_bytes)
    return decode_pieces(pieces), rejected_files(pieces)


def read_captures(spark: SparkSession, folder: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All packets of the capture files in a folder.

    ``packet_id`` is the byte position in the file, so ordering by it is file order;
    ``sensor_id`` is the file. A record cut off at the end of a file is left out.
    """
    return open_captures(spark, folder, piece_bytes)[0]
