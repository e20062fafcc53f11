"""Untrusted bytes: bounded work, error rows, never an uncaught exception."""

import random
import struct
import time

import pytest

from pagelake.functions import container as ct
from pagelake.functions import limits as lim
from pagelake.functions.container import content_body
from pagelake.functions.drawing import Display, render_emf
from pagelake.functions.emf_writer import Emf
from pagelake.functions.errors import DocumentError, TooLarge
from pagelake.functions.records import Attr
from pagelake.functions.tlv import element, number_bytes
from pagelake.operators import edits
from pagelake.sources import model as md
from pagelake.sources.files import SCHEMAS, _rows, decode
from pagelake.sources.render import document_text, render_page

HUGE = 3_840 << 20


def claimed(size: int) -> bytes:
    """A document whose properties claim ``size`` bytes."""
    raw = md.blank().raw
    t = ct.find_trailer(raw)
    body = raw[: t.at]
    v = element(0x80, b"\0") + element(0x82, b"\0") + element(0x83, number_bytes(size)) + element(0x84, number_bytes(t.stored)) + element(0x85, number_bytes(t.check))
    return body + element(ct.TRAILER, v + element(0x86, (len(v) + 6).to_bytes(4, "little")))


def with_drawing(body: bytes) -> bytes:
    d = md.blank()
    edits.add_annotation(d, 0, 0, 0, 1000, 1000, {"type": "rect", "fill": 0})
    d.records[4].set(7, body)
    return d.save_fresh()


def test_expansion_is_refused_before_it_happens():
    start = time.monotonic()
    with pytest.raises(TooLarge), lim.scope(lim.Limits()):
        md.Document.open(claimed(HUGE))
    bomb = element(0x80, b"\x04") + element(0x81, number_bytes(HUGE)) + element(0x86, b"\0" * 50)
    with pytest.raises(TooLarge), lim.scope(lim.Limits()):
        d = md.Document.open(with_drawing(bomb))
        render_page(d, d.pages()[0])
    assert time.monotonic() - start < 2


def test_counts_are_cut_and_records_are_limited():
    e = Emf(1000, 1000)
    e.put(4, "<iiiiI", 0, 0, 0, 0, 0x7FFFFFFF, tail=struct.pack("<4i", 1, 2, 3, 4))
    for _ in range(50):
        e.put(54, "<ii", 5, 5)
    d = md.Document.open(with_drawing(content_body(4, [], e.done())))
    x = render_page(d, d.pages()[0])
    assert sum(i["kind"] == "stroke" for i in x.items) == 51
    with pytest.raises(TooLarge), lim.scope(lim.Limits(maxRecords=20)):
        render_page(d, d.pages()[0])
    with pytest.raises(TooLarge), lim.scope(lim.Limits(maxPoints=1)):
        render_page(d, d.pages()[0])
    assert lim.last_usage()["failed"]


def test_images_and_pages_are_limited():
    info = struct.pack("<IiiHHIIiiII", 40, 60_000, 60_000, 1, 8, 1, 0, 0, 0, 0, 0) + b"\0" * 1024
    e = Emf(1000, 1000)
    e.bitmap(0, 0, 100, 100, info, b"\0\1", 60_000, 60_000)
    with pytest.raises(TooLarge), lim.scope(lim.Limits()):
        render_emf(e.done(), (1000, 1000), Display(), [], True)
    with pytest.raises(TooLarge), lim.scope(lim.Limits(maxPages=3)):
        md.Document.open(md.blank(pages=4).raw)
    with pytest.raises(TooLarge), lim.scope(lim.Limits(maxBytes=10)):
        md.Document.open(md.blank().raw)


def test_mutated_files_end_in_document_errors():
    r = random.Random(9)
    d = md.blank()
    for s in ({"type": "text", "text": "some text"}, {"type": "rect", "fill": 3}, {"type": "sticky", "text": "n"}):
        edits.add_annotation(d, 0, 100, 100, 0, 0, s)
    raw, opened = d.save_fresh(), 0
    for _ in range(250):
        b = bytearray(raw)
        how = r.randrange(4)
        for _ in range(r.randint(1, 6)):
            if how == 0:
                b[r.randrange(len(b))] = r.randrange(256)
            elif how == 1:
                at = r.randrange(len(b))
                del b[at : at + r.randint(1, 20)]
            elif how == 2:
                at = r.randrange(len(b))
                b[at:at] = bytes(r.randrange(256) for _ in range(r.randint(1, 9)))
            else:
                b = b[: r.randrange(1, len(b))]
        try:
            with lim.scope(lim.Limits(deadline=5)):
                got = md.Document.open(bytes(b))
                opened += 1
                document_text(got)
        except (DocumentError, IndexError, ValueError, struct.error):
            pass
    assert opened > 0


def test_bad_files_become_rows(spark):
    good = md.blank().raw
    files = spark.createDataFrame([("a", good), ("b", b""), ("c", b"\x60garbage" * 9), ("d", claimed(HUGE)), ("e", None)], "path string, content binary")
    for name in SCHEMAS:
        rows = {r.path: r for r in decode(files, name).collect()}
        assert [rows[k].error_class for k in "bcde"] == ["NotXdw", rows["c"].error_class, "TooLarge", "NotXdw"] and rows["c"].error_class
        assert "a" not in rows or rows["a"].error_class is None
        assert list(_rows(name, md.Document.open(good), False)) is not None
    assert {r.path for r in decode(files, "containers", mode="DROPMALFORMED").collect()} == {"a"}
    with pytest.raises(Exception):
        decode(files, "containers", mode="FAILFAST").collect()


def test_odd_attributes_do_not_break_pages():
    d = md.blank()
    d.records[2].attrs.append(Attr(0xC0, 51, b"\x81\x01\x63\x82\x01\x05"))
    d.records.insert(3, md.record(3, md.PLACE))
    d.records.insert(4, md.record(4, md.TEXT))
    assert [(o.x, o.w, o.text) for o in d.pages()[0].objects] == [(0, 0, None)]
