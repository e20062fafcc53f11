"""Queries through bytes: rows become documents, documents become rows. The oracle is SQL over the rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.plans.fixtures import frame
from pagelake.plans.queries import query
from pagelake.sources.files import decode, map_bytes, plain_text_document, text_document


def _files(df: DataFrame, key: str, columns: list[str], make) -> DataFrame:
    return map_bytes(df, key, columns, make).select(F.col(key).cast("string").alias("path"), "content")


@query("roundtrip_text", "select doc_id, regexp_replace(text, chr(0), '', 'g') as text from documents")
def roundtrip_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text into a file's settings and out of the decoded objects."""
    files = _files(frame(spark, sf, "select doc_id, text from documents"), "doc_id", ["text"], plain_text_document)
    return decode(files, "objects").select(F.col("path").cast("long").alias("doc_id"), "text")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of one small file, dealt over the tasks: making and reading a document takes about 20 ms."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, rows.columns[0])


def _drawn(text: str):
    return text_document(text)


@query("render_text", "select item_id, text from benchmark")
def render_text(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages drawn as annotations, interpreted, and assembled from their runs."""
    files = _files(frame(spark, sf, "select item_id, text from benchmark"), "item_id", ["text"], _drawn)
    return decode(files, "text").select(F.col("path").cast("long").alias("item_id"), "text")


def _shape(n: int, w: float, h: float):
    from pagelake.operators.edits import add_annotation, rotate_page
    from pagelake.sources.model import blank

    d = blank()
    add_annotation(d, 0, 1000 + n % 500, 2000, w, h, {"type": "rect", "stroke": 0xFF0000, "fill": n % 0xFFFFFF, "width": 10.0})
    rotate_page(d, 0, n % 4)
    return d.save()


def _roundtrip_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles added and their pages turned, in files, against arithmetic on the rows."""
    rows = _spread(frame(spark, sf, f"select p_partkey as n, cast(p_size * 10 + 100 as double) as w, cast(p_size * 20 + 200 as double) as h from part")).withColumn("m", F.col("n"))
    files = _files(rows, "n", ["m", "w", "h"], _shape)
    return decode(files, "objects").select(F.col("path").cast("long").alias("n"), "kind_name", "x", "w", "rotation")


@query("roundtrip_objects", "select p_partkey as n, 'rectangle' as kind_name, case p_partkey % 4 when 0 then 1000 + p_partkey % 500 when 1 then 29700 - 2000 - p_size * 20 - 200 when 2 then 21000 - (1000 + p_partkey % 500) - p_size * 10 - 100 else 2000 end as x, case when p_partkey % 2 = 0 then p_size * 10 + 100 else p_size * 20 + 200 end as w, (p_partkey % 4) * 90 as rotation from part")
def roundtrip_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _roundtrip_objects(spark, sf)


@query("file_checks", "select item_id, true as properties_ok, 0 as bad, true as round_trip from benchmark")
def file_checks(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(frame(spark, sf, "select item_id, text from benchmark"), "item_id", ["text"], _drawn)
    return decode(files, "checks").select(F.col("path").cast("long").alias("item_id"), "properties_ok", F.size("bad_entries").alias("bad"), "round_trip")


@query("file_info", "select item_id, 10 as generation, 1 as n_segments, 0 as n_entries, 1 as n_pages from benchmark")
def file_info(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(frame(spark, sf, "select item_id, text from benchmark"), "item_id", ["text"], _drawn)
    return decode(files, "containers").select(F.col("path").cast("long").alias("item_id"), "generation", "n_segments", "n_entries", "n_pages")


def _compressed(text: str):
    from pagelake.functions import lzh

    raw = text.encode()
    return lzh.decompress(lzh.compress(raw), len(raw)), "lzh"


@query("lzh_round_trip", "select item_id, text from benchmark")
def lzh_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    out = map_bytes(frame(spark, sf, "select item_id, text from benchmark"), "item_id", ["text"], _compressed)
    return out.select("item_id", F.decode("content", "UTF-8").alias("text"))


def _script(n: int):
    from pagelake.operators.edits import run_script
    from pagelake.sources.model import blank

    ops = [{"op": "blank_page", "at": 1, "w": 25700, "h": 36400}, {"op": "move_page", "from": 1, "to": 0}, {"op": "rotate", "page": 0, "q": n % 4}]
    ops += [{"op": "add", "page": 1, "x": 100, "y": 200, "w": 300, "h": 400, "shape": {"type": "ellipse", "fill": 255}}] * (n % 3)
    return run_script(blank(), ops + [{"op": "delete_page", "page": 0}] * (n % 5 == 0)).save()


def _edit_script(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts of edits over files; each is a fold over one file, files are independent."""
    rows = _spread(frame(spark, sf, f"select p_partkey as n, p_partkey as m from part"))
    return decode(_files(rows, "n", ["m"], _script), "pages").select(F.col("path").cast("long").alias("n"), "page_no", "w", "n_objects")


@query("edit_script", "select n, case when n % 5 = 0 then 0 else p end as page_no, case when p = 1 then 21000 when n % 2 = 0 then 25700 else 36400 end as w, case when p = 1 then n % 3 else 0 end as n_objects from (select p_partkey as n, unnest([0, 1]) as p from part) q where n % 5 <> 0 or p = 1")
def edit_script(spark: SparkSession, sf: str) -> DataFrame:
    return _edit_script(spark, sf)


# single steps of reading and writing, over one small document for each benchmark passage

_PASSAGES = "select item_id, text from benchmark"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _files(frame(spark, sf, _PASSAGES), "item_id", ["text"], _drawn)


def _id(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("path").cast("long").alias("item_id"), *columns)


@query("open_document", "select item_id, cast(null as varchar) as error_class, 1 as pages from benchmark")
def open_document(spark, sf):
    return _id(decode(_documents(spark, sf), "containers"), "error_class", F.col("n_pages").alias("pages"))


@query("parse_records", "select item_id, 8 as n, 4 as deepest from benchmark")
def parse_records(spark, sf):
    r = decode(_documents(spark, sf), "records").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))
    return _id(r, "n", "deepest")


@query("attr_defs", "select item_id, 31 as n from benchmark")
def attr_defs(spark, sf):
    return _id(decode(_documents(spark, sf), "attr_defs").groupBy("path").agg(F.count(F.lit(1)).alias("n")), "n")


@query("attr_ints", "select item_id, 21000 as w, 29700 as h from benchmark")
def attr_ints(spark, sf):
    a = decode(_documents(spark, sf), "attrs").join(decode(_documents(spark, sf), "records").filter("kind = 4865").select("path", "rec_no"), ["path", "rec_no"]).filter("tag = 5")
    return _id(a, F.col("ints")[0].alias("w"), F.col("ints")[1].alias("h"))


@query("scan_segments", "select item_id, 1 as n, 0 as entries from benchmark")
def scan_segments(spark, sf):
    s = decode(_documents(spark, sf), "segments").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entries")).alias("entries"))
    return _id(s, "n", "entries")


@query("blank_document", "select p_partkey as n, 1000 + p_size * 100 as w, 2000 + p_size * 100 as h from part")
def blank_document(spark, sf):
    rows = _spread(frame(spark, sf, "select p_partkey as n, 1000 + p_size * 100 as w, 2000 + p_size * 100 as h from part"))
    return decode(_files(rows, "n", ["w", "h"], _blank), "pages").select(F.col("path").cast("long").alias("n"), "w", "h")


@functools.lru_cache(maxsize=256)
def _blank(w: int, h: int):
    """Equal sizes have equal bytes. They are only written here; ``decode`` reads each file."""
    from pagelake.sources.model import blank_tree, write_tree

    return write_tree(blank_tree(w, h)), "fresh"


def _saved(how: str):
    def make(text: str):
        from pagelake.operators.edits import insert_blank_page
        from pagelake.sources.model import Document

        d = Document.open(text_document(text)[0])
        insert_blank_page(d, 1, 25700, 36400)
        return (d.save_fresh() if how == "fresh" else d.save_append()), how

    return make


@query("save_fresh", "select item_id, 1 as n_segments, 2 as n_pages from benchmark")
def save_fresh(spark, sf):
    files = _files(frame(spark, sf, _PASSAGES), "item_id", ["text"], _saved("fresh"))
    return _id(decode(files, "containers"), "n_segments", "n_pages")


@query("save_append", "select item_id, 2 as n_segments, 2 as n_pages from benchmark")
def save_append(spark, sf):
    files = _files(frame(spark, sf, _PASSAGES), "item_id", ["text"], _saved("append"))
    return _id(decode(files, "containers"), "n_segments", "n_pages")


def _pictured(n: int):
    import numpy as np

    from pagelake.operators.pictures import add_picture
    from pagelake.sources.model import blank

    d = blank()
    add_picture(d, 0, 100, 200, 300, 400, np.full((2 + n % 3, 3, 4), n % 256, np.uint8), see_through=n % 2 == 1)
    return d.save()


def _sink_image(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(frame(spark, sf, f"select p_partkey as n, p_partkey as m from part"))
    return decode(_files(rows, "n", ["m"], _pictured), "images").select(F.col("path").cast("long").alias("n"), "page_no", "w", "h")


@query("sink_image", "select p_partkey as n, 0 as page_no, 3 as w, 2 + p_partkey % 3 as h from part")
def sink_image(spark, sf):
    return _sink_image(spark, sf)


def _add_picture(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(frame(spark, sf, f"select p_partkey as n, p_partkey as m from part"))
    return decode(_files(rows, "n", ["m"], _pictured), "objects").select(F.col("path").cast("long").alias("n"), "kind_name", "x")


@query("add_picture", "select p_partkey as n, case when p_partkey % 2 = 1 then 'object' else 'picture' end as kind_name, 100 as x from part")
def add_picture(spark, sf):
    return _add_picture(spark, sf)


@query("sink_json", "select item_id, 0 as page_no, min(len(string_split(text, chr(10)))) as runs from benchmark group by 1")
def sink_json(spark, sf):
    """The display list as JSON, one row a page; runs counts the text items in it."""
    items = decode(_documents(spark, sf), "items")
    row = F.struct("item_no", "kind", "text", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("size", 1).alias("size"))
    pages_ = items.groupBy("path", "page_no").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
    return _id(pages_, "page_no", F.size(F.regexp_extract_all("json", F.lit('"kind":"(text)"'), F.lit(1))).alias("runs"))


@query("render_page", "select item_id, 0 as skipped from benchmark")
def render_page_(spark, sf):
    d = decode(_documents(spark, sf), "text").select("path")
    s = decode(_documents(spark, sf), "skipped").groupBy("path").agg(F.count(F.lit(1)).alias("skipped"))
    return _id(d.join(s, "path", "left"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def _pdf(text: str):
    from pagelake.functions.pdf import from_document

    return from_document(text_document(text)[0], "t"), "pdf"


@query("sink_pdf", "select item_id, '%PDF-1.4' as head, true as whole from benchmark")
def sink_pdf(spark, sf):
    out = map_bytes(frame(spark, sf, _PASSAGES), "item_id", ["text"], _pdf)
    return out.select("item_id", F.decode(F.substring("content", 1, 8), "UTF-8").alias("head"), F.col("content").cast("string").endswith("%%EOF\n").alias("whole"))


@query("corpus_digest", "select item_id, 1 as pages, length(text) as chars from benchmark")
def corpus_digest(spark, sf):
    """One row a file: pages and characters, besides the hashes that a later run is compared by."""
    t = decode(_documents(spark, sf), "text")
    d = t.groupBy("path").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.bit_xor(F.xxhash64("page_no", "text")).alias("digest"))
    return _id(d.filter("digest is not null"), "pages", "chars")


def _sjis(text: str):
    from pagelake.functions.text import sjis_decode, sjis_encode

    return sjis_decode(sjis_encode(text)).encode(), "sjis"


@query("decode_sjis", "select p_partkey, concat(p_name, ' 資料（', p_type, '）') as text from part")
def decode_sjis(spark, sf):
    out = map_bytes(frame(spark, sf, "select p_partkey, concat(p_name, ' 資料（', p_type, '）') as text from part"), "p_partkey", ["text"], _sjis)
    return out.select("p_partkey", F.decode("content", "UTF-8").alias("text"))


def _named(text: str, wide: bool):
    from pagelake.functions.text import name_decode, sjis_encode, utf16_value

    return name_decode(utf16_value(text) if wide else sjis_encode(text) + b"\0").encode(), "name"


@query("decode_name", "select p_partkey, concat(p_name, ' 資料') as text from part")
def decode_name(spark, sf):
    out = map_bytes(frame(spark, sf, "select p_partkey, concat(p_name, ' 資料') as text, p_partkey % 2 = 0 as wide from part"), "p_partkey", ["text", "wide"], _named)
    return out.select("p_partkey", F.decode("content", "UTF-8").alias("text"))


def _listed(a: int, b: int):
    from pagelake.functions import tlv

    return tlv.ints_bytes([a, -b, a * b]), "ints"


@query("ints_encode", "select p_partkey, p_size - p_partkey * 7 as total from part")
def ints_encode(spark, sf):
    out = map_bytes(frame(spark, sf, "select p_partkey, p_partkey * 7 as a, p_size as b from part"), "p_partkey", ["b", "a"], _listed)
    from pagelake.operators.binary import tlv_number

    n1 = F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("int")
    out = out.withColumn("n1", n1).withColumn("n2", F.expr("cast(conv(hex(substring(content, n1 + 2, 1)), 16, 10) as int)"))
    return out.select("p_partkey", (tlv_number(F.expr("substring(content, 2, n1)")) + tlv_number(F.expr("substring(content, n1 + 3, n2)"))).alias("total"))


def _broken(n: int):
    raw = plain_text_document("text")[0]
    return (raw[: len(raw) - n % 2] if n % 3 else b"\x60" * (n % 40)), "bytes"


def _safe_read(spark: SparkSession, sf: str) -> DataFrame:
    """Broken files among whole ones: error rows, not a failed job."""
    rows = _spread(frame(spark, sf, f"select p_partkey as n, p_partkey as m from part"))
    c = decode(_files(rows, "n", ["m"], _broken), "containers")
    whole = F.col("error_class").isNull()
    return c.select(F.col("path").cast("long").alias("n"), F.when(whole, "ok").when(F.col("path").cast("long") % 3 == 0, F.col("error_class")).otherwise("bad").alias("result"))


#: Broken files of 24 bytes and more are long enough to be read into: their first element runs past the end.
@query("safe_read", "select p_partkey as n, case when p_partkey % 3 = 0 and p_partkey % 40 < 24 then 'NotXdw' when p_partkey % 3 = 0 then 'Corrupt' when p_partkey % 2 = 0 then 'ok' else 'bad' end as result from part")
def safe_read(spark, sf):
    return _safe_read(spark, sf)


def _limited(text: str):
    from pagelake.functions.limits import Limits

    return str(Limits.from_json(text).maxPages).encode(), "limits"


@query("limits_json", "select p_partkey, case when p_size % 3 = 0 then 20000 else p_size end as n from part")
def limits_json(spark, sf):
    rows = frame(spark, sf, "select p_partkey, concat('{\"maxPages\": ', case when p_size % 3 = 0 then -p_size else p_size end, ', \"other\": 1}') as text from part")
    out = map_bytes(rows, "p_partkey", ["text"], _limited)
    return out.select("p_partkey", F.decode("content", "UTF-8").cast("long").alias("n"))


def _bindered(n: int):
    from pagelake.operators.edits import add_binder_docs
    from pagelake.sources import model as md

    d = md.Document.open(md.write_tree([md.record(0, md.BINDER), md.record(1, md.BINDER_LIST)], md.BINDER))
    for k in range(1 + n % 3):
        add_binder_docs(d, k, md.blank(pages=1 + k), f"doc {k}")
    return d.save()


def _add_binder_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spread(frame(spark, sf, f"select p_partkey as n, p_partkey as m from part"))
    b = decode(_files(rows, "n", ["m"], _bindered), "binder_docs")
    return b.select(F.col("path").cast("long").alias("n"), "doc_no", "name", F.col("first_page").cast("long").alias("first_page"), "pages")


@query("add_binder_docs", "select n, k as doc_no, 'doc ' || k as name, cast(k * (k + 1) / 2 as bigint) as first_page, k + 1 as pages from (select p_partkey as n, unnest(range(1 + p_partkey % 3)) as k from part) q")
def add_binder_docs(spark, sf):
    return _add_binder_docs(spark, sf)


@query("nfkc_fold", "select p_partkey, lower(p_name) as folded from part")
def nfkc_fold(spark, sf):
    out = map_bytes(frame(spark, sf, "select p_partkey, upper(p_name) as text from part"), "p_partkey", ["text"], _folded)
    return out.select("p_partkey", F.decode("content", "UTF-8").alias("folded"))


def _folded(text: str):
    from pagelake.functions.text import fold

    return fold("".join(chr(ord(c) + 0xFEE0) if "A" <= c <= "Z" else c for c in text)).encode(), "fold"
