"""Files as tables: decoding, and writing documents.

A file is decoded in one Arrow call into the rows of one table; a file that cannot be read becomes a
row with error_class and error_msg, or is dropped, or fails the job, by ``mode``.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import container as ct
from pagelake.functions import limits as lim
from pagelake.functions import records as rc
from pagelake.functions.covered import page_text
from pagelake.functions.errors import DocumentError
from pagelake.functions.tlv import ints
from pagelake.session import ship
from pagelake.sources.model import Document
from pagelake.sources.render import render_page

ERROR = "error_class string, error_msg string"
SCHEMAS = {
    "containers": "path string, size long, generation int, trailer_tag int, n_segments int, n_entries int, expanded long, stored long, is_binder boolean, is_signed boolean, n_pages int",
    "segments": "path string, seg_no int, at long, `end` long, entries array<long>, props_at long, trailer_at long",
    "entries": "path string, entry_no int, at long, len long, chk long, is_fields boolean, kind long, expanded_size long, body binary",
    "records": "path string, rec_no int, depth int, kind long, parent_no int, subtree_end int",
    "attrs": "path string, rec_no int, attr_no int, class int, tag long, name string, value binary, ints array<long>",
    "attr_defs": "path string, rec_no int, def_no int, tag long, ty long, idx long, name string",
    "pages": "path string, page_no int, rec_no int, w long, h long, n_objects int",
    "objects": "path string, page_no int, obj_no int, place_no int, rec_no int, kind long, kind_name string, x long, y long, w long, h long, rotation long, text string",
    "binder_docs": "path string, doc_no int, rec_no int, name string, first_page int, pages int",
    "signatures": "path string, sig_no int, module string, version string, stamp boolean",
    "references": "path string, rec_no int, attr_no int, entry_no int",
    "items": "path string, page_no int, item_no int, obj_no int, kind string, color int, text string, x double, y double, size double, angle double, xs array<double>, path_json string, clip int, mul boolean, alpha double",
    "text": "path string, page_no int, text string, hidden_chars int",
    "skipped": "path string, page_no int, reason string",
    "images": "path string, page_no int, img_no int, w int, h int, codec string",
    "checks": "path string, properties_ok boolean, bad_entries array<int>, round_trip boolean",
}


def _rows(table: str, d: Document, include_hidden: bool) -> Iterator[tuple]:
    if table == "containers":
        t = d.container.trailer
        yield d.container.size, d.container.generation, t.tag, len(ct.segments(d.raw)), len(d.entries), t.expanded, t.stored, d.is_binder, d.is_signed, len(d.pages())
    elif table == "segments":
        for n, s in enumerate(ct.segments(d.raw)):
            yield n, s.at, s.end, s.entries, s.properties[0] if s.properties else None, s.trailer
    elif table == "entries":
        for n, e in enumerate(d.entries):
            yield n, e.at, e.len, e.check, e.is_fields, e.kind, e.expanded_size, e.body
    elif table == "records":
        up = rc.parents(d.records)
        for n, r in enumerate(d.records):
            yield n, r.depth, r.kind, up[n] if up[n] >= 0 else None, rc.subtree_end(d.records, n)
    elif table == "attrs":
        for n, r in enumerate(d.records):
            names = {x.tag: x.name for x in reversed(d.defs(n))}
            for k, a in enumerate(r.attrs):
                yield n, k, a.cls, a.tag, names.get(a.tag), a.value, ints(a.value)
    elif table == "attr_defs":
        for n in range(len(d.records)):
            for k, x in enumerate(d.defs(n)):
                yield n, k, x.tag, x.type, x.index, x.name
    elif table == "binder_docs":
        for n, b in enumerate(d.binder_docs()):
            yield n, b.record, b.name, b.first_page, b.pages
    elif table == "signatures":
        for n, s in enumerate(d.signatures()):
            yield n, s["module"], s["version"], s["stamp"]
    elif table == "references":
        yield from rc.references(d.records)
    elif table == "checks":
        v = d.verify()
        yield v["properties_ok"], v["bad_entries"], v["round_trip"]
    else:
        yield from _page_rows(table, d, include_hidden)


def _page_rows(table: str, d: Document, include_hidden: bool) -> Iterator[tuple]:
    for n, p in enumerate(d.pages()):
        if table == "pages":
            yield n, p.record, p.w, p.h, len(p.objects)
            continue
        if table == "objects":
            for k, o in enumerate(p.objects):
                yield n, k, o.place, o.record, o.kind, o.kind_name, o.x, o.y, o.w, o.h, o.rotation, o.text
            continue
        x = render_page(d, p, include_hidden)
        if table == "text":
            yield n, page_text(x), x.hidden_chars
        elif table == "skipped":
            yield from ((n, s) for s in x.skipped)
        elif table == "images":
            yield from ((n, k, i["w"], i["h"], "jpeg" if "jpeg" in i else "rgba") for k, i in enumerate(x.images))
        else:
            for k, i in enumerate(x.items):
                yield n, k, i.get("object"), i["kind"], i.get("color"), i.get("text"), i.get("x"), i.get("y"), i.get("size"), i.get("angle"), i.get("xs"), json.dumps(i["path"]) if "path" in i else None, i["clip"], i.get("mul"), i.get("alpha")


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def decode(files: DataFrame, table: str, limits: lim.Limits = lim.Limits(), mode: str = "PERMISSIVE", include_hidden: bool = False) -> DataFrame:
    """Rows of ``table`` for files (path, content). Large contents come a few to an Arrow batch."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"mode {mode}")
    ship(files.sparkSession)
    ddl = f"{SCHEMAS[table]}, {ERROR}"
    schema = _arrow_schema(ddl)
    width = len(schema) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    with lim.scope(limits):
                        rows += [(path, *r, None, None) for r in _rows(table, Document.open(content.as_py() or b""), include_hidden)]
                except Exception as e:  # noqa: BLE001  bytes of any kind come in; each ends as rows
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        rows.append((path, *[None] * width, getattr(e, "kind", "Corrupt"), str(e)[:500]))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Document files below ``path`` by extension, either case; any file system that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{xdw,XDW,xbd,XBD}").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length", "content")


def read_documents(spark: SparkSession, path: str, table: str = "objects", **options) -> DataFrame:
    return decode(scan_files(spark, path), table, lim.Limits.from_options({k: str(v) for k, v in options.items()}), options.get("mode", "PERMISSIVE"), bool(options.get("include_hidden", False)))


def map_bytes(df: DataFrame, key: str, columns: Iterable[str], make: Callable[..., tuple[bytes, str]]) -> DataFrame:
    """key, content, how, and errors, with ``make`` run on each row's columns."""
    ship(df.sparkSession)
    kind, columns = df.schema[key].dataType.simpleString(), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(b.column(i + 1).to_pylist() for i in range(len(columns)))):
                try:
                    out.append((*make(*row), None, None))
                except DocumentError as e:
                    out.append((None, None, e.kind, str(e)[:500]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.string()) for c in cols[1:])], [key, "content", "how", "error_class", "error_msg"])

    return df.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, content binary, how string, {ERROR}")


def text_document(text: str | None, size: float = 12.0) -> tuple[bytes, str]:
    """A document of one page with one text annotation."""
    from pagelake.operators.edits import add_annotation
    from pagelake.sources.model import blank

    d = blank()
    add_annotation(d, 0, 1000, 1000, 0, 0, {"type": "text", "text": text or "", "size": size})
    return d.save()


def plain_text_document(text: str | None) -> tuple[bytes, str]:
    """The same with the text's settings alone: nothing is drawn, so it is much cheaper to make."""
    from pagelake.functions import text as tx
    from pagelake.functions.records import named
    from pagelake.sources import model as md

    tree = md.blank_tree(md.DEFAULT_W, md.DEFAULT_H)
    at = next(i for i, r in enumerate(tree) if r.kind == md.PAGE) + 1
    place = md.record(3, md.PLACE, md.ints_attr(rc.POSITION, 1000, 1000))
    tree[at:at] = [place, md.record(4, md.TEXT, *named([(4, "%Text(w", tx.utf16_value(text or ""))]), md.ints_attr(rc.SIZE, 5000, 5000))]
    return md.write_tree(tree), "fresh"


def write_documents(contents: DataFrame, path: str, name: str = "doc_id") -> DataFrame:
    """Write one file for each row of (name, content) below a shared ``path``; returns paths and lengths.

    Files go to a temporary name first and are moved, so a task that runs again leaves whole files.
    The folder must be one that executors and driver share.
    """
    kind = contents.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        for b in batches:
            paths, sizes = [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = os.path.join(path, f"{k}.xdw")
                fd, part = tempfile.mkstemp(dir=path)
                with os.fdopen(fd, "wb") as f:
                    f.write(c)
                os.replace(part, out)
                paths.append(out)
                sizes.append(len(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], [name, "path", "length"])

    return contents.filter(F.col("content").isNotNull()).select(name, "content").mapInArrow(run, f"`{name}` {kind}, path string, length long")


def edit_files(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each file (path, content) with its script (path, script): the edited file, or the error."""
    from pagelake.operators.edits import run_script

    def make(content: bytes, script: str | None) -> tuple[bytes, str]:
        d = Document.open(content)
        return run_script(d, script or "[]").save()

    return map_bytes(files.join(scripts, "path", "left"), "path", ["content", "script"], make)
