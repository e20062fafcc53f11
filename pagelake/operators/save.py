"""What a save keeps: references, reachable entries, new numbers, offsets; and the PDF's code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["file_id"]


def reachable(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Entries that something refers to; many references count once, so a semi join."""
    return entries.join(refs.select(*FILE, "entry_no"), FILE + ["entry_no"], "left_semi")


def garbage(entries: DataFrame, refs: DataFrame) -> DataFrame:
    return entries.join(refs.select(*FILE, "entry_no"), FILE + ["entry_no"], "left_anti")


def renumber(entries: DataFrame, base: int = 0) -> DataFrame:
    """new_no: dense numbers in old order by file, from ``base``."""
    return entries.withColumn("new_no", F.row_number().over(Window.partitionBy(*FILE).orderBy("entry_no")) - 1 + base)


def repoint(refs: DataFrame, numbered: DataFrame) -> DataFrame:
    """References with the new numbers of their entries."""
    return refs.join(numbered.select(*FILE, "entry_no", "new_no"), FILE + ["entry_no"])


def pending_compact(pending: DataFrame, refs: DataFrame, own: DataFrame) -> DataFrame:
    """New entries still referred to, numbered after the file's own (own_n)."""
    kept = renumber(reachable(pending, refs))
    return kept.join(own.select(*FILE, "own_n"), FILE).withColumn("new_no", F.col("new_no") + F.col("own_n")).drop("own_n")


def offsets(entries: DataFrame, start: int) -> DataFrame:
    """Where each entry of a segment begins: a running sum of the lengths before."""
    w = Window.partitionBy(*FILE).orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("at", F.lit(start) + F.coalesce(F.sum("len").over(w), F.lit(0)))


def body_lookup(refs: DataFrame, own: DataFrame, pending: DataFrame) -> DataFrame:
    """Each reference's body, of the file's own entries or the new ones."""
    return refs.join(own.unionByName(pending), FILE + ["entry_no"])


def set_content(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with the bodies in ``new`` (new_len) in place of their own."""
    return entries.join(new, FILE + ["entry_no"], "left").withColumn("len", F.coalesce("new_len", "len")).drop("new_len")


def verify(entries: DataFrame) -> DataFrame:
    """By file: whether all check values hold, and the entries where they do not. Entries without one are not counted."""
    bad = F.col("chk").isNotNull() & (F.col("chk") != F.col("actual"))
    return entries.groupBy(*FILE).agg(F.every(~bad).alias("ok"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(bad, F.col("entry_no"))))).alias("bad_entries"))


def save_mode(signed: Column) -> Column:
    return F.when(signed, "append").otherwise("fresh")


def pdf_codes(chars: DataFrame, document: list[str]) -> DataFrame:
    """A code for each different character, from 1 in order of first use, below 0xFFFF."""
    first = chars.groupBy(*document, "ch").agg(F.min("seq").alias("seq"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(*document).orderBy("seq"))).filter("code < 65535")


def pdf_tounicode(codes: DataFrame, document: list[str], block: int = 100) -> DataFrame:
    """Lines of the code map, sorted by character, in blocks; characters beyond U+FFFF as two UTF-16 units."""
    n = F.row_number().over(Window.partitionBy(*document).orderBy("ch")) - 1
    cp = F.ascii("ch")
    over = cp - 0x10000
    pair = F.format_string("%04X%04X", F.lit(0xD800) + F.shiftright(over, 10), F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF)))
    line = F.format_string("<%04X> <%s>", F.col("code"), F.when(cp < 0x10000, F.format_string("%04X", cp)).otherwise(pair))
    part = codes.withColumn("n", n).withColumn("block_no", F.floor(F.col("n") / block)).withColumn("line", line)
    return part.groupBy(*document, "block_no").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])).alias("bfchar"))


def pdf_points(x: Column, y: Column, page_h: Column) -> list[Column]:
    """1/100 mm from the top left to points from the bottom left."""
    return [x * 72.0 / 2540.0, (page_h - y) * 72.0 / 2540.0]


def latest_segment(segments: DataFrame) -> DataFrame:
    """The state in effect: the last trailer of each file."""
    return segments.groupBy(*FILE).agg(F.max_by(F.struct("seg_no", "trailer_at"), "seg_no").alias("s")).select(*FILE, "s.seg_no", "s.trailer_at")
