"""Byte vectors of the format (conformance), without Spark."""

import struct

import numpy as np
import pytest

from pagelake.functions import container as ct
from pagelake.functions import dib, lzh, pdf, tlv
from pagelake.functions import records as rc
from pagelake.functions import text as tx
from pagelake.functions.drawing import dw_points
from pagelake.functions.errors import DocumentError, Unsupported
from pagelake.functions.limits import Limits
from pagelake.operators.pictures import fit
from pagelake.sources import model as md


def test_numbers_and_checks():
    assert tlv.check(bytes.fromhex("010000000200000009")) == 3
    assert tlv.signed32_bytes(0xFFA1B1AE).hex() == "a1b1ae" and tlv.number_bytes(0xC013).hex() == "00c013"
    assert tlv.ints(bytes.fromhex("025208027404")) == [21000, 29700] and tlv.ints(b"\x01\xff") == [-1]
    assert tlv.ints_bytes([21000, 29700, -1, 600, 128]).hex() == "02520802740401ff020258020080"
    assert tlv.ints(b"\x00\x09" + b"\x01" * 9 + b"\x05\x01") == [0, 0]


def test_lengths():
    assert [tlv.element(0x63, b"\0" * n)[:5].hex() for n in (0x7F, 0xFE, 0xFF, 0x10000)] == ["637f000000", "6381fe0000", "638200ff00", "6383010000"]
    for bad in (b"\x60\x80", b"\x60\x85\0\0\0\0\0", b"\x60\x02\0", b"\x60"):
        with pytest.raises(DocumentError):
            tlv.read(bad, 0)


def test_records():
    raw = bytes.fromhex("6208800100620300c013" + "6210800102620213018302" + "0101" + "9f8f510105")
    tree = rc.parse(raw)
    assert [r.depth for r in tree] == [0, 2] and tree[1].ints(3) == [1] and tree[1].get(2001).value == b"\x05"
    assert rc.write(tree) == raw


def test_references():
    assert rc.reference_bytes(3, 6041).hex() == "81010382021799"
    packed = rc.reference_bytes(303, 1283094, 598778)
    assert packed.hex() == "8102012f82031394168303" + "0922fa" and rc.renumbered(packed, 2).hex() == "810102" + "82031394168303" + "0922fa"
    assert rc.reference(packed) == (303, 1283094) and rc.reference(b"\xff") is None


def test_new_document():
    d = md.blank()
    assert d.raw[:16].hex() == "600e82010a800300c01383" + "04010d0a01"
    assert [hex(r.kind) for r in d.records] == ["0xc013", "0x1303", "0x1301", "0x1304", "0x1306", "0x1305"]
    assert d.named_ints(1, "lastmid") == [1] and d.named_ints(2, "lastmid") == [0]
    assert d.save_fresh() == d.raw
    with pytest.raises(Unsupported):
        md.blank(0, 29700)


def test_protected():
    t = ct.Trailer(10, ct.TRAILER, 1, [0], [], b"", 0, 4, 0)
    assert ct.is_protected(bytes.fromhex("6702aabb660401020304"), t) and ct.is_protected(bytes.fromhex("6402aabb660401020304"), t)
    assert not ct.is_protected(bytes.fromhex("6402aabb630401020304"), t)


def test_points():
    assert dw_points(bytes.fromhex("040000000a0014007f9128f7"), 0x80) == [(10, 20), (17, 19), (10, 20), (12, 11)]
    assert dw_points(bytes.fromhex("020000000a001400fe05"), 0x40) == [(10, 20), (8, 25)]
    assert len(dw_points(b"\xff\xff\xff\x7f\0\0\0\0" + b"\x11" * 5, 0x80)) == 6


def test_bitmap():
    head = bytearray(48)
    for k, v in {0: 40, 4: 2, 8: 2, 12: 1, 14: 1, 44: 255, 45: 255, 46: 255}.items():
        head[k] = v
    got = dib.decode(bytes(head), bytes.fromhex("8000000040000000"))["rgba"][..., 0]
    assert got.tolist() == [[0, 255], [255, 0]]
    assert dib.jpeg_size(b"no jpeg") is None


@pytest.mark.parametrize("depth", [8, 24, 32])
def test_bitmaps_round_trip(depth):
    rgba = np.random.default_rng(0).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    rgba[..., 3] = 255
    info, bits = dib.rgba_to_24(rgba)
    if depth == 32:
        info = struct.pack("<IiiHHIIiiII", 40, 7, -5, 1, 32, 0, 0, 0, 0, 0, 0)
        bits = np.dstack([rgba[..., 2], rgba[..., 1], rgba[..., 0], rgba[..., 3]]).tobytes()
    if depth == 8:
        rgba[..., 1] = rgba[..., 2] = rgba[..., 0]
        info = struct.pack("<IiiHHIIiiII", 40, 7, -5, 1, 8, 0, 0, 0, 0, 0, 0) + b"".join(bytes([i, i, i, 0]) for i in range(256))
        bits = b"".join(r[:, 0].tobytes() + b"\0" for r in rgba)
    assert (dib.decode(info, bits)["rgba"] == rgba).all()
    assert (dib.stored(dib.stored_bytes(info, bits, 5))["rgba"] == rgba).all()


def test_names():
    assert tx.name_decode(bytes.fromhex("d030a430f330c030fc3000")) == "バインダー"
    assert tx.name_decode(b"plain\0") == "plain" and tx.name_decode("資料A（表紙）".encode("cp932") + b"\0") == "資料A（表紙）" and tx.name_decode("Ab".encode("utf-16-le")) == "Ab"
    assert tx.sjis_encode("aé①") == b"a&#233;\x87\x40" and tx.sjis_decode(b"\xb1\xa0\x82") == "ｱ��"


def test_fit():
    assert fit(200, 100, 50, 50) == [50, 0, 100, 100]


@pytest.mark.parametrize("raw", [b"", b"a", b"ab", b"a" * 28, bytes(range(256)) * 9, b"the quick brown fox " * 400, b"\0" * 70_000])
def test_compression(raw):
    assert lzh.decompress(lzh.compress(raw), len(raw)) == raw


def test_pdf():
    items = [{"kind": "text", "text": "Aé漢", "x": 1000.0, "y": 2000.0, "size": 400.0, "angle": 0.0, "xs": [0.0, 200.0, 400.0]}]
    out = pdf.write([(21000, 29700, items)], title="t")
    assert out.startswith(b"%PDF-1.4") and b"/Count 1" in out and b"<0001> <0041>" in out and b"<0003> <6F22>" in out
    start = int(out.rsplit(b"startxref\n", 1)[1].split()[0])
    assert out[start : start + 4] == b"xref"


def test_limits_text():
    got = Limits.from_json('{"maxPages": 5, "maxBytes": 0, "nope": 3, "maxPoints": -1}')
    assert got == Limits(maxPages=5)
    assert Limits.from_json('{"maxRecords": 1e6, "maxPoints": "x"}').maxRecords == 1_000_000
    assert Limits().expand_cap(10) == 10 * 1000 + 65536


def test_search_text():
    assert tx.matches("aaAa", "aa") == [0, 1, 2] and tx.matches("ＡＢc", "abC") == [0] and tx.matches("x", "") == []


def test_compound_files():
    from pagelake.functions import cfb

    streams = {"big": bytes(range(250)) * 20, "a": b"small", "bb": b"", "ccc": b"x" * 4095, "\x01Ole": b"y" * 70}
    out = cfb.write(streams, cfb.METAFILE)
    assert out[:8].hex() == "d0cf11e0a1b11ae1" and len(out) % 512 == 0
    assert out[512:5512] == streams["big"] and cfb.read(out) == streams
    assert [cfb.depth(n) for n in (1, 3, 4)] == [0, 1, 2]
    assert cfb.read(cfb.write({"one": b"1" * 70_000}))["one"] == b"1" * 70_000
    file = cfb.ole_file(b"E" * 300)
    assert len(file) == 22 + int.from_bytes(file[18:22], "little") and cfb.read(file[22:])["CONTENTS"][112:] == b"E" * 300
