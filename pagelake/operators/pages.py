"""Pages, objects, binders and settings over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.operators.tree import FILE, ancestor
from pagelake.sources.model import CONTENT, KIND_NAMES, OLE, PAGE, PICTURE, PLACE, SIGNATURE

#: Paper sizes, 1/100 mm, portrait.
PAPERS = {"A3": (29700, 42000), "A4": (21000, 29700), "A5": (14800, 21000), "B4": (25700, 36400), "B5": (18200, 25700)}


def find_pages(records: DataFrame) -> DataFrame:
    """Pages in tree order: page_no, rec_no, w, h."""
    order = Window.partitionBy(*FILE).orderBy("rec_no")
    return records.filter(F.col("kind") == PAGE).select(*FILE, "rec_no", "w", "h").withColumn("page_no", F.row_number().over(order) - 1)


def page_objects(records: DataFrame) -> DataFrame:
    """For each placement one level under a page, its first child: the object, with its page and box."""
    r = ancestor(ancestor(records, PAGE, 2, "page_rec"), PLACE, 3, "place_no").filter("page_rec is not null and place_no is not null and place_no > page_rec")
    places = r.filter(F.col("kind") == PLACE).select(*FILE, "page_rec", "place_no", "x", "y", "w", "h")
    first = Window.partitionBy(*FILE, "place_no").orderBy("rec_no")
    children = r.filter("depth = 4").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*FILE, "place_no", F.col("rec_no").alias("obj_rec"), "kind", "rotation")
    return places.join(children, FILE + ["place_no"])


def kind_names(spark) -> DataFrame:
    return spark.createDataFrame(list(KIND_NAMES.items()), "kind int, kind_name string")


def with_kind_name(objects: DataFrame) -> DataFrame:
    """The kind in words; a fixed table of a few rows is broadcast, the rest are annotations."""
    return objects.join(F.broadcast(kind_names(objects.sparkSession)), "kind", "left").withColumn("kind_name", F.coalesce("kind_name", F.lit("annotation")))


def object_text(values: DataFrame) -> DataFrame:
    """Wide text before narrow text, by record (rec_no, name, value)."""
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return values.groupBy(*FILE, "rec_no").agg(F.coalesce(pick("%Text(w"), pick("%Text")).alias("text"))


def pages_report(objects: DataFrame) -> DataFrame:
    """One JSON list of objects for each page, in order."""
    o = F.struct("place_no", "kind", "x", "y", "w", "h")
    return objects.groupBy(*FILE, "page_rec").agg(F.count(F.lit(1)).alias("n_objects"), F.to_json(F.transform(F.array_sort(F.collect_list(o)), lambda s: F.struct(s["kind"].alias("kind"), s["x"].alias("x"), s["y"].alias("y")))).alias("objects"))


def paper_name(w: Column, h: Column, near: int = 60) -> Column:
    """The paper of a page, either way up, within ``near``."""
    out = None
    for name, (a, b) in PAPERS.items():
        fits = ((F.abs(w - a) < near) & (F.abs(h - b) < near)) | ((F.abs(w - b) < near) & (F.abs(h - a) < near))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("")


def binder_docs(docs: DataFrame) -> DataFrame:
    """first_page: the pages of all documents before; an empty one starts where the one before ended."""
    w = Window.partitionBy("binder").orderBy("doc_no").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("first_page", F.coalesce(F.sum("pages").over(w), F.lit(0)))


def signed_files(files: DataFrame, records: DataFrame, kind: int = SIGNATURE) -> DataFrame:
    """Files that hold a signature: a left semi join, so a file counts once."""
    return files.join(records.filter(F.col("kind") == kind).select(*FILE), FILE, "left_semi")


def signature_info(values: DataFrame) -> DataFrame:
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    out = values.groupBy(*FILE, "rec_no").agg(pick("%smin").alias("module"), pick("%sigver").alias("version"))
    return out.withColumn("stamp", F.coalesce(F.col("module").contains("電子印鑑") | F.col("module").contains("Stamp"), F.lit(False)))


def settings(values: DataFrame, names: list[str]) -> DataFrame:
    """Named attributes as columns: one pivot with its names given, so one pass."""
    return values.groupBy(*FILE, "rec_no").pivot("name", names).agg(F.first("value"))


def picture_kind(kind: Column, marked: Column) -> Column:
    return F.when(kind == PICTURE, "opaque").when((kind == OLE) & marked, "see-through")


def editable(kind: Column, marked: Column) -> Column:
    return kind.isin(0x8011, 0x801A, 0x803C, 0x803D, 0x803E, 0x8033) | picture_kind(kind, marked).isNotNull()


def can_move(kind: Column) -> Column:
    return ~kind.isin(CONTENT, SIGNATURE)


def object_pictures(objects: DataFrame, attrs: DataFrame) -> DataFrame:
    """Pictures 1..n of each object (n_pictures): attribute 300 + k up to the hundredth, then by index."""
    wanted = objects.filter("n_pictures > 0").select(*FILE, "rec_no", F.explode(F.sequence(F.lit(1), F.col("n_pictures"))).alias("k"))
    by_tag = attrs.filter("tag between 301 and 400").select(*FILE, "rec_no", (F.col("tag") - 300).alias("k"), F.col("entry_no").alias("e1"))
    by_index = attrs.filter("name = '#pd' and idx > 100").select(*FILE, "rec_no", F.col("idx").alias("k"), F.col("entry_no").alias("e2"))
    return wanted.join(by_tag, FILE + ["rec_no", "k"], "left").join(by_index, FILE + ["rec_no", "k"], "left").select(*FILE, "rec_no", "k", F.coalesce("e1", "e2").alias("entry_no")).filter("entry_no is not null")


def drawing_ref(cls: Column, entry_no: Column) -> Column:
    """entry: the entry referred to (private class); null where the drawing is inline."""
    return F.when(cls.bitwiseAND(192) == 192, entry_no)
