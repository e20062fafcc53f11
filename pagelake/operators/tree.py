"""The object tree over tables of records (file_id, rec_no, depth, kind, ...).

A tree is read in order once: all windows here share one partitioning and one sort by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["file_id"]


def _levels(records: DataFrame, levels: int | None) -> tuple[DataFrame, int]:
    """The levels to look at: those of the records where none are given. A record deeper than given fails the job."""
    if levels is None:
        deepest = records.agg(F.max("depth")).first()[0]
        return records, 1 if deepest is None else deepest + 1
    beyond = F.raise_error(F.format_string("a record at depth %d, beyond the levels given", "depth")).cast("int")
    return records.withColumn("depth", F.when(F.col("depth") >= levels, beyond).otherwise(F.col("depth"))), levels


def with_parent(records: DataFrame, levels: int | None = None) -> DataFrame:
    """parent_no: the nearest earlier record of smaller depth, by the last record seen at each level."""
    records, levels = _levels(records, levels)
    w = Window.partitionBy(*FILE).orderBy("rec_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("depth") > d, F.max(F.when(F.col("depth") == d, F.col("rec_no"))).over(w)) for d in range(levels)]
    return records.withColumn("parent_no", F.greatest(*last, F.lit(None).cast("long"), F.lit(None).cast("long")))


def with_subtree_end(records: DataFrame, levels: int | None = None) -> DataFrame:
    """subtree_end: the next record of the same or smaller depth, or one past the file's last.

    Records are read backwards, so that each level's next record is a running minimum.
    """
    records, levels = _levels(records, levels)
    w = Window.partitionBy(*FILE).orderBy(F.desc("rec_no"))
    after = w.rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.when(F.col("depth") >= d, F.min(F.when(F.col("depth") == d, F.col("rec_no"))).over(after)) for d in range(levels)]
    end = F.max("rec_no").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return records.withColumn("subtree_end", F.least(*nexts, end))


def ancestor(records: DataFrame, kind: int, depth: int, out: str) -> DataFrame:
    """The enclosing record of ``kind`` at ``depth``, itself included: an as-of lookup by one window."""
    w = Window.partitionBy(*FILE).orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn(out, F.when(F.col("depth") >= depth, F.max(F.when((F.col("depth") == depth) & (F.col("kind") == kind), F.col("rec_no"))).over(w)))


def subtree(records: DataFrame, roots: DataFrame) -> DataFrame:
    """All records of the subtrees of ``roots`` (file_id, root_no, subtree_end)."""
    return records.join(roots, FILE).filter((F.col("rec_no") >= F.col("root_no")) & (F.col("rec_no") < F.col("subtree_end")))


def dump_line(depth: Column, kind: Column, rec_no: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth), F.lower(F.lpad(F.hex(kind), 4, "0")), F.lit(" #"), rec_no.cast("string"))


def external_defs(attrs: DataFrame, entries: DataFrame) -> DataFrame:
    """Attributes with the entry their definition list is kept in, where it is kept in one (left outer)."""
    return attrs.join(entries.select(*FILE, "entry_no", "len"), FILE + ["entry_no"], "left")


def named_attrs(attrs: DataFrame, defs: DataFrame) -> DataFrame:
    """Attributes by name; of several with one name in a record the first counts."""
    joined = attrs.join(defs, FILE + ["tag"])
    first = Window.partitionBy(*FILE, "rec_no", "name").orderBy("attr_no", "value")
    return joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def change_attrs(attrs: DataFrame, edits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw edits (new_value, del) by ``keys``: set where there is a value, drop where del."""
    joined = attrs.join(edits, keys or FILE + ["rec_no", "tag"], "left").filter(~F.coalesce("del", F.lit(False)))
    return joined.withColumn("value", F.coalesce("new_value", "value")).drop("new_value", "del")
