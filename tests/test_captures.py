"""Capture files written by the test itself."""

import struct

import pytest
from pyspark.sql import functions as F

from netweave.operators import sequencing as sq
from netweave.sources import captures


def ethernet(ip, vlan=False):
    kind = b"\x81\x00\x00\x05\x08\x00" if vlan else b"\x08\x00"
    return b"\0" * 12 + kind + ip


def ipv4(proto, body, ttl=64, flags=2, src="10.0.0.1", dst="192.168.1.9", words=5):
    head = struct.pack(">BBHHHBBH", 0x40 | words, 0, 20 + len(body), 7, flags << 13, ttl, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def tcp(sport=1000, dport=443, flags=0x12, window=512):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 0x50, flags, window, 0, 0)


def udp(sport=53, dport=5353, data=b"xx"):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def capture(packets, order="<", magic=0xA1B2C3D4, link=1, start=1_700_000_000):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, data in enumerate(packets):
        fraction = 250_000 if magic == 0xA1B2C3D4 else 250_000_000
        out += struct.pack(order + "IIII", start + i, fraction, len(data), len(data)) + data
    return out


def read(spark, folder, **options):
    return captures.read_captures(spark, str(folder), **options).orderBy("sensor_id", "packet_id").collect()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("magic", [0xA1B2C3D4, 0xA1B23C4D])
def test_fields_of_each_kind(spark, tmp_path, order, magic):
    packets = [
        ethernet(ipv4(6, tcp())),
        ethernet(ipv4(17, udp())),
        ethernet(ipv4(1, b"\x08\0\0\0")),
        b"\0" * 12 + b"\x08\x06" + b"\0" * 28,
        ethernet(ipv4(6, tcp(dport=80)), vlan=True),
        ethernet(ipv4(6, tcp(), words=2)),
    ]
    (tmp_path / "a.pcap").write_bytes(capture(packets, order, magic))
    rows = read(spark, tmp_path)
    assert [r["proto"] for r in rows] == [6, 17, 1, None, 6, 6]
    first = rows[0]
    assert (first["src_ip"], first["dst_ip"], first["ip_len"], first["ip_flags"]) == ("10.0.0.1", "192.168.1.9", 40, 2)
    assert (first["src_port"], first["dst_port"], first["tcp_flags"], first["tcp_window"]) == (1000, 443, 18, 512)
    assert (first["packet_size"], first["ihl"], first["ttl"], first["udp_len"]) == (54, 5, 64, None)
    assert first["ts"].timestamp() == 1_700_000_000.25
    assert (rows[1]["src_port"], rows[1]["udp_len"], rows[1]["tcp_flags"]) == (53, 10, None)
    assert rows[2]["src_port"] is None and rows[3]["packet_size"] == 42
    assert rows[4]["dst_port"] == 80 and rows[5]["ihl"] == 2


def test_small_pieces_give_the_same_packets_in_file_order(spark, tmp_path):
    packets = [ethernet(ipv4(6, tcp(sport=1000 + i))) for i in range(40)]
    (tmp_path / "a.pcap").write_bytes(capture(packets))
    whole, cut = read(spark, tmp_path), read(spark, tmp_path, piece_bytes=100)
    assert [r["src_port"] for r in whole] == [1000 + i for i in range(40)]
    assert whole == cut


def test_truncated_record_other_files_and_names(spark, tmp_path):
    data = capture([ethernet(ipv4(6, tcp())), ethernet(ipv4(17, udp()))])
    (tmp_path / "cut.PCAP").write_bytes(data[:-3])
    (tmp_path / "note.pcap").write_bytes(b"not a capture at all, only text")
    (tmp_path / "empty.pcap").write_bytes(capture([]))
    (tmp_path / "a.txt").write_bytes(data)
    rows = read(spark, tmp_path)
    assert [r["proto"] for r in rows] == [6]


def test_raw_ip_link(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([ipv4(17, udp())], link=101))
    assert read(spark, tmp_path)[0]["udp_len"] == 10


def test_training_upload_to_sequences(spark, tmp_path):
    packets = [ethernet(ipv4(6, tcp(sport=1000 + i))) for i in range(33)]
    (tmp_path / "a.pcap").write_bytes(capture(packets))
    labelled = captures.read_captures(spark, str(tmp_path)).withColumn("is_training", F.lit(True))
    rows = sq.build_sequences(labelled, sq.SequenceRule(order=["packet_id"])).orderBy("seq_no").collect()
    assert len(rows) == 2 and all(r["is_training"] for r in rows)
    assert rows[0]["mean_gap"] == pytest.approx(1.0) and rows[0]["unscaled"][0][3] == pytest.approx(1.0)
    assert rows[1]["familiarity"] == 0.0


@pytest.mark.parametrize(
    "name, allowed", [("a.pcap", True), ("a.PCAP", True), ("a.b.pcap", True), ("pcap", False), ("a.pcap.gz", False), (".pcap", True)]
)
def test_allowed_names(spark, name, allowed):
    assert spark.range(1).select(captures.allowed_file(F.lit(name))).first()[0] is allowed


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    length = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + length + body + length


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order, link=1, longest=65535, resolution=None, offset=None):
    options = b""
    if resolution is not None:
        options += struct.pack(order + "HHBxxx", 9, 1, resolution)
    if offset is not None:
        options += struct.pack(order + "HHq", 14, 8, offset)
    return block(order, 1, struct.pack(order + "HHI", link, 0, longest) + options + (b"\0" * 4 if options else b""))


def enhanced(order, data, ticks, number=0):
    return block(order, 6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)


SECONDS = 1_700_000_000


@pytest.mark.parametrize("order", ["<", ">"])
def test_block_files(spark, tmp_path, order):
    data = section(order) + interface(order) + interface(order, link=113, resolution=9, offset=100) + interface(order, link=276, resolution=0x80 | 10)
    data += enhanced(order, ethernet(ipv4(6, tcp())), SECONDS * 1_000_000 + 5)
    data += block(order, 5, b"statistics..")
    data += enhanced(order, b"\0" * 14 + b"\x08\x00" + ipv4(17, udp()), SECONDS * 10**9 + 7_000, number=1)
    data += enhanced(order, b"\x08\x00" + b"\0" * 18 + ipv4(17, udp(sport=99)), SECONDS * 1024 + 512, number=2)
    data += block(order, 3, struct.pack(order + "I", 60) + ethernet(ipv4(1, b"\x08\0\0\0" + b"\0" * 22)))
    data += block(order, 2, struct.pack(order + "HHIIII", 0, 0, 0, 77, 20, 20) + b"\0" * 20)
    other = ">" if order == "<" else "<"
    data += section(other) + interface(other, link=101) + enhanced(other, ipv4(17, udp(sport=7)), SECONDS * 1_000_000)
    data += enhanced(other, b"", 0, number=5)  # an interface that was not described
    (tmp_path / "a.pcap").write_bytes(data)
    whole = read(spark, tmp_path)
    assert [(r["proto"], r["src_port"], r["packet_size"]) for r in whole] == [(6, 1000, 54), (17, 53, 46), (17, 99, 50), (1, None, 60), (None, None, 20), (17, 7, 30)]
    assert [r["ts"] and round(r["ts"].timestamp() - SECONDS, 6) for r in whole] == [0.000005, 100.000007, 0.5, None, round(77e-6 - SECONDS, 6), 0.0]
    for size in (60, 100, 333):
        assert read(spark, tmp_path, piece_bytes=size) == whole
    assert captures.open_captures(spark, str(tmp_path), 100)[1].collect() == []


def test_cooked_links(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([b"\0" * 14 + b"\x08\x00" + ipv4(6, tcp()), b"\0" * 14 + b"\x86\xdd" + b"\x60" + b"\0" * 40], link=113))
    (tmp_path / "b.pcap").write_bytes(capture([b"\x08\x00" + b"\0" * 18 + ipv4(17, udp())], link=276))
    assert [(r["proto"], r["tcp_window"], r["udp_len"]) for r in read(spark, tmp_path)] == [(6, 512, None), (None, None, None), (17, None, 10)]


def test_a_row_for_each_file_that_cannot_be_read(spark, tmp_path):
    data = capture([ethernet(ipv4(6, tcp())), ethernet(ipv4(17, udp()))])
    (tmp_path / "cut.pcap").write_bytes(data[:-3])
    (tmp_path / "note.pcap").write_bytes(b"not a capture at all, only text" * 20)
    (tmp_path / "none.pcap").write_bytes(b"")
    (tmp_path / "fine.pcap").write_bytes(data)
    blocks = section("<") + interface("<") + enhanced("<", ethernet(ipv4(6, tcp())), 1)
    (tmp_path / "blocks.pcap").write_bytes(blocks + enhanced("<", ethernet(ipv4(6, tcp())), 2)[:-4] + b"oops" + enhanced("<", ethernet(ipv4(6, tcp())), 3))
    for size in (80, 1 << 20):
        packets, rejects = captures.open_captures(spark, str(tmp_path), size)
        found = sorted((r["path"].rsplit("/", 1)[1], r["reason"], r["position"]) for r in rejects.collect())
        # Spark's file readers leave out a file without a byte
        assert found == [("blocks.pcap", "cut_off", len(blocks)), ("cut.pcap", "cut_off", len(data) - 44 - 16), ("note.pcap", "not_a_capture", 0)]
        assert packets.count() == 1 + 2 + 1


@pytest.mark.parametrize("size", [64, 200, 1000])
def test_packets_that_look_like_records_mislead_nobody(spark, tmp_path, size):
    """Payloads are whole captures themselves, so a piece that begins inside one finds chains that are not the file's."""
    inner = capture([ethernet(ipv4(17, udp(sport=1)))] * 12)[24:]
    packets = [ethernet(ipv4(17, udp(sport=2000 + i, data=inner))) for i in range(9)] + [ethernet(ipv4(6, tcp()))] * 3
    (tmp_path / "a.pcap").write_bytes(capture(packets))
    rows = read(spark, tmp_path, piece_bytes=size)
    assert [r["src_port"] for r in rows] == [2000 + i for i in range(9)] + [1000] * 3
    assert rows == read(spark, tmp_path)


def test_search_for_a_first_record():
    import io

    data = capture([ethernet(ipv4(6, tcp(sport=1000 + i))) for i in range(40)])
    layout = captures.layout_of(data[:28])
    starts = [24 + 70 * i for i in range(40)]
    for begin in range(24, len(data)):
        source = captures.Source(io.BytesIO(data), len(data), begin, 512)
        wanted = next((s for s in starts if s >= begin), None)
        assert captures.first_record(source, begin, len(data), layout) == wanted
