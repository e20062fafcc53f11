"""Our writer against our reader: self-consistency, not conformance."""

import numpy as np
import pytest

from pagelake.functions import container as ct
from pagelake.functions.covered import page_text, remove_covered
from pagelake.functions.drawing import Display, rect_path
from pagelake.functions.errors import DocumentError, Unsupported
from pagelake.operators import edits, pictures
from pagelake.sources import model as md
from pagelake.sources.render import document_text, render_page

TEXT = {"type": "text", "text": "氏名 山田太郎", "size": 12}
SHAPES = [
    {"type": "text", "text": "two\nlines é", "size": 10.5, "color": 0x102030, "bold": True, "background": 0xFFFFFF, "frame": 0xFF},
    {"type": "rect", "stroke": 0xFF0000, "width": 20.0, "fill": None, "highlight": False},
    {"type": "rect", "stroke": None, "width": 1.0, "fill": 0xFFFF00, "highlight": True},
    {"type": "ellipse", "stroke": 0x00FF00, "width": 35.0, "fill": 0x0000FF},
    {"type": "line", "points": [[0.0, 0.0], [500.0, 900.0]], "color": 0x123456, "width": 30.0},
    {"type": "stamp", "top": "承認", "date": "'26.01.02", "bottom": "山田", "color": 0xE60012},
    {"type": "sticky", "text": "note", "size": 12.0, "color": 0, "background": 0xFFFF64},
]


def same(shape, got):
    return all(got[k] == v for k, v in shape.items())


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: s["type"])
def test_shapes_read_back(shape):
    d = md.blank()
    edits.add_annotation(d, 0, 2000, 3000, 0 if shape["type"] in ("text", "stamp", "sticky") else 1500, 1500, shape)
    for out in (d.save_fresh(), d.save_append()):
        back = md.Document.open(out)
        assert same(shape, edits.shape_of(back, 0, 0)) and not render_page(back, back.pages()[0]).skipped
        assert back.save_fresh() == md.Document.open(back.save_fresh()).save_fresh()


def _page(*shapes):
    d = md.blank()
    for x, y, w, h, s in shapes:
        edits.add_annotation(d, 0, x, y, w, h, s)
    return render_page(d, d.pages()[0]), d


def test_covered_text():
    w, h = edits.text_box(TEXT["text"], 12)
    black = {"type": "rect", "stroke": None, "fill": 0}
    at = (2000, 3000, 0, 0, TEXT)
    assert page_text(_page(at)[0]) == TEXT["text"] and _page(at)[0].hidden_chars == 0
    x, d = _page(at, (1900, 2900, w + 200, h + 200, black))
    assert page_text(x) == "" and x.hidden_chars == 6
    assert page_text(render_page(d, d.pages()[0], include_hidden=True)) == TEXT["text"]
    half = page_text(_page(at, (2000 + 0.45 * w, 2900, w, h + 200, black))[0])
    assert half.startswith("氏名") and "郎" not in half
    assert page_text(_page(at, (1900, 2900, w + 200, h + 200, black | {"highlight": True}))[0]) == TEXT["text"]
    assert page_text(_page((1900, 2900, w + 200, h + 200, black), at)[0]) == TEXT["text"]


def test_pictures_cover_when_opaque():
    rgba = np.full((4, 4, 4), 255, np.uint8)
    for see_through, left in ((False, ""), (True, TEXT["text"])):
        _, d = _page((2000, 3000, 0, 0, TEXT))
        pictures.add_picture(d, 0, 1900, 2900, 6000, 2000, rgba, see_through)
        back = md.Document.open(d.save_fresh())
        assert document_text(back) == [left]
        assert pictures.picture_kind(back, 0, 1) == ("see-through" if see_through else "opaque")
        pictures.set_picture(back, 0, 1, 0, 0, 500, 500, not see_through)
        assert pictures.picture_kind(back, 0, 1) == ("opaque" if see_through else "see-through")
        assert pictures.picture_pixels(back, 0, 1).shape == (4, 4, 4)


def _display(path, even_odd=False):
    run = {"kind": "text", "text": "氏名山田太郎", "x": 1000.0, "y": 2000.0, "size": 400.0, "angle": 0.0, "xs": [400.0 * k for k in range(6)], "clip": 0}
    return Display(items=[run, {"kind": "fill", "path": path, "color": 0, "even_odd": even_odd, "mul": False, "clip": 0}])


def test_part_of_a_run_and_holes():
    d = _display(rect_path(1790.0, 1500.0, 3410.0, 2100.0))
    remove_covered(d)
    assert d.hidden_chars == 4 and page_text(d) == "氏名"
    d = _display(rect_path(0, 0, 9000, 9000) + rect_path(900, 1500, 3500, 2200), even_odd=True)
    remove_covered(d)
    assert d.hidden_chars == 0


def _jpeg(w, h):
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"\0" * 9 + b"\xff\xd9"


def test_pages_move_turn_and_copy():
    d = md.blank()
    for s in SHAPES:
        edits.add_annotation(d, 0, 1000, 1000, 900, 900, s)
    pictures.insert_image_page(d, 1, 29700, 21000, _jpeg(40, 30), runs=[{"x": 1000, "y": 2000, "size": 400, "text": "under"}])
    edits.insert_blank_page(d, 2, 25700, 36400)
    edits.rotate_page(d, 2, 1)
    back = md.Document.open(d.save_fresh())
    pages = back.pages()
    assert len(ct.segments(back.raw)) == 1 and [(p.w, p.h) for p in pages] == [(21000, 29700), (29700, 21000), (36400, 25700)]
    assert [i["jpeg"] for i in render_page(back, pages[1]).images] == [_jpeg(40, 30)] and back.container.trailer.checks
    assert document_text(back)[1] == "under"  # text under its own page's picture stays
    pictures.set_thumbnail(d, 1, np.zeros((3, 3, 4), np.uint8))
    assert len(md.Document.open(d.save_fresh()).entries) == len(back.entries) + 1
    new = md.blank()
    assert edits.insert_pages_from(new, 1, back, [1, 0, 1]) == 3
    assert len(new.pending) == 2  # each entry copied once
    again = md.Document.open(new.save_fresh())
    assert document_text(again)[1:] == ["under", document_text(back)[0], "under"] and len(again.entries) == 2
    before = document_text(again)
    edits.move_page(again, 1, 3)
    assert document_text(again) == [before[0], before[2], before[3], before[1]]
    edits.delete_page(again, 1)
    edits.delete_page(again, 2)
    edits.delete_page(again, 1)
    assert len(md.Document.open(again.save_fresh()).entries) == 0 and len(md.Document.open(again.save_append()).entries) == 2
    with pytest.raises(Unsupported):
        edits.delete_page(again, 0)


def _binder():
    tree = [md.record(0, md.BINDER), md.record(1, md.BINDER_LIST), md.record(1, 0x1304)]
    d = md.Document.open(md.write_tree(tree, md.BINDER))
    for k, name in enumerate(("資料", "two", "three")):
        edits.add_binder_docs(d, k, md.blank(pages=k + 1), name)
    return d


def test_binders():
    d = md.Document.open(_binder().save_fresh())
    view = lambda: [(b.name, b.first_page, b.pages) for b in d.binder_docs()]
    assert view() == [("資料", 0, 1), ("two", 1, 2), ("three", 3, 3)]
    edits.move_binder_doc(d, 0, 2)
    edits.rename_binder_doc(d, 0, " 2 ")
    assert view() == [("2", 0, 2), ("three", 2, 3), ("資料", 5, 1)]
    with pytest.raises(Unsupported):
        edits.delete_page(d, 5)
    edits.move_page(d, 0, 5)
    edits.delete_binder_doc(d, 1)
    assert view() == [("2", 0, 1), ("資料", 1, 2)] and d.is_binder
    assert edits.add_binder_docs(d, 9, _binder(), "first") == 3 and [b.name for b in d.binder_docs()][2:] == ["first", "two", "three"]


def test_scripts_and_errors():
    d = edits.run_script(md.blank(), '[{"op":"add","page":0,"x":1,"y":2,"w":300,"h":300,"shape":{"type":"ellipse","fill":255}},{"op":"move","page":0,"obj":0,"x":5,"y":6},{"op":"blank_page","at":9},{"op":"delete","page":0,"obj":0}]')
    assert [len(p.objects) for p in d.pages()] == [0, 0]
    for bad in ('[{"op":"nope"}]', '[{"op":"move","page":3,"obj":0}]', '[{"op":"delete","page":0,"obj":1}]'):
        with pytest.raises(DocumentError):
            edits.run_script(md.blank(), bad)


def test_signed_documents_are_appended_to():
    d = md.blank()
    d.records[3:3] = [edits.place_record(3, 0, 0, 100, 100), md.record(4, md.SIGNATURE, *md.named([(4, "%smin", "Stamp 1".encode() + b"\0"), (4, "%sigver", b"6.0\0")]))]
    signed = md.Document.open(d.save_fresh())
    out, how = signed.save()
    assert how == "append" and out.startswith(signed.raw) and signed.signatures() == [{"module": "Stamp 1", "version": "6.0", "stamp": True}]
    for f in (edits.delete_object, lambda *a: edits.move_object(*a, 1, 1)):
        with pytest.raises(Unsupported):
            f(signed, 0, 0)
