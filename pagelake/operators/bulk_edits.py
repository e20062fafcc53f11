"""The edits of one document, in bulk over tables: each returns the table after the edit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.operators.pages import can_move
from pagelake.session import ship


def next_numbers(owners: DataFrame, members: DataFrame, owner: list[str]) -> DataFrame:
    """The next free number of each owner: one more than its lastmid and its members' numbers."""
    top = members.groupBy(*owner).agg(F.max("num").alias("_top"))
    return owners.join(top, owner, "left").withColumn("next_num", F.greatest(F.col("lastmid"), F.coalesce("_top", F.lit(0))) + 1).drop("_top")


def resequenced(rows: DataFrame, part: list[str], order: list[Column | str], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)


def add_objects(objects: DataFrame, new: DataFrame, page: list[str]) -> DataFrame:
    """New objects go after the page's own; objects are numbered again."""
    both = objects.select(*page, "obj_no", "kind", "x", "y", F.lit(0).alias("_new")).unionByName(new.select(*page, "obj_no", "kind", "x", "y", F.lit(1).alias("_new")))
    return resequenced(both, page, ["_new", "obj_no"], "n").drop("_new")


def change_objects(objects: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Replace the rows that ``changes`` has; page content cannot be changed."""
    from pagelake.sources.model import CONTENT

    usable = changes.join(objects.filter(F.col("kind") != CONTENT).select(*keys), keys, "left_semi")
    return objects.join(usable, keys, "left_anti").select(*keys, *columns).unionByName(usable.select(*keys, *columns))


def move_objects(objects: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """New positions (nx, ny) where given; page content and signatures stay."""
    ok = F.col("nx").isNotNull() & can_move(F.col("kind"))
    moved = objects.join(moves, keys, "left")
    return moved.withColumn("x", F.when(ok, F.col("nx")).otherwise(F.col("x"))).withColumn("y", F.when(ok, F.col("ny")).otherwise(F.col("y"))).drop("nx", "ny")


def delete_objects(objects: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """All but the objects in ``gone``; page content and signatures stay."""
    return objects.join(gone.select(*keys), keys, "left_anti").unionByName(objects.filter(~can_move(F.col("kind"))).join(gone.select(*keys), keys, "left_semi"))


def delete_pages(pages: DataFrame, gone: DataFrame, document: list[str], keys: list[str], order: str | None = None) -> DataFrame:
    """All but the pages in ``gone``, which are deleted one after another by ``order`` (the last of ``keys``).

    A document's only page is never deleted, so of a document all of whose pages are to go the last one stays.
    """
    order = order or keys[-1]
    marked = pages.join(gone.select(*keys, F.lit(True).alias("_gone")), keys, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    whole = Window.partitionBy(*document)
    marked = marked.withColumn("_left", F.count_if(~F.col("_gone")).over(whole)).withColumn("_last", F.max(order).over(whole))
    return marked.filter(~F.col("_gone") | (F.col("_left") == 0) & (F.col(order) == F.col("_last"))).drop("_gone", "_left", "_last")


def move_page(pages: DataFrame, document: list[str]) -> DataFrame:
    """Move page ``source`` of each document to ``target``: after it going down, before it going up. new_no: the new order."""
    down = F.col("target") > F.col("source")
    key = F.when(F.col("page_no") == F.col("source"), F.col("target") + F.when(down, 0.5).otherwise(-0.5)).otherwise(F.col("page_no").cast("double"))
    return resequenced(pages, document, [key], "new_no")


def insert_pages(pages: DataFrame, new: DataFrame, document: list[str]) -> DataFrame:
    """Pages of ``new`` (at) before page ``at``, at most after the last. new_no: the order with them."""
    n = pages.groupBy(*document).agg(F.count(F.lit(1)).alias("_n"))
    added = new.join(n, document).select(*document, (F.least("at", "_n") - 0.5).alias("_k"), "w", "h")
    return resequenced(pages.select(*document, F.col("page_no").cast("double").alias("_k"), "w", "h").unionByName(added), document, ["_k"], "new_no").drop("_k")


def import_entries(refs: DataFrame, bodies: DataFrame, target: list[str]) -> DataFrame:
    """Copied pages' references with new entry numbers: each source entry is copied once, after the target's own (base)."""
    used = refs.select(*target, "source", "entry_no", "base").distinct().join(bodies.select("source", "entry_no"), ["source", "entry_no"], "left_semi")
    numbered = used.withColumn("new_no", F.col("base") + F.row_number().over(Window.partitionBy(*target).orderBy("source", "entry_no")) - 1)
    return refs.join(numbered.drop("base"), target + ["source", "entry_no"])


def rename(docs: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(names, keys, "left").withColumn("name", F.coalesce(F.trim("new_name"), "name")).drop("new_name")


def page_range(text: Column, n: Column) -> Column:
    """Pages of ``1-3,5``, from 1, in the order written; ranges may run backwards; beyond ``n`` is cut."""
    part = lambda s: F.split(F.trim(s), "\\s*-\\s*")
    low, high = lambda s: F.try_element_at(part(s), F.lit(1)).try_cast("long"), lambda s: F.try_element_at(part(s), F.lit(-1)).try_cast("long")
    none = F.array().cast("array<long>")

    def pages(s: Column) -> Column:  # both ends are held to 1..n before the range is written out
        a, b, first = F.least(low(s), high(s)), F.greatest(low(s), high(s)), F.lit(1).cast("long")
        a, b, up = F.greatest(a, first), F.least(b, n.cast("long")), low(s) <= high(s)
        return F.when(low(s).isNull() | high(s).isNull() | (a > b), none).otherwise(F.when(up, F.sequence(a, b)).otherwise(F.reverse(F.sequence(a, b))))

    return F.flatten(F.transform(F.split(text, ","), pages)).cast("array<int>")


def history(log: DataFrame, document: list[str], order: str, depth: int = 200) -> DataFrame:
    """After each step of a log of edits (0), undos (-1) and redos (1): the edits in effect (version), and the
    steps that can be undone and done again. At most ``depth`` can be undone; an edit ends what could be done again.

    Each step depends on all before it, so a document's log is folded in one task, in Arrow batches.
    """
    ship(log.sparkSession)
    log = log.select(*document, order, "step")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        shown = back = ahead = 0
        rows = []
        for step in t["step"].to_pylist():
            if step == 0:
                shown, back, ahead = shown + 1, min(back + 1, depth), 0
            elif step == -1 and back:
                shown, back, ahead = shown - 1, back - 1, ahead + 1
            elif step == 1 and ahead:
                shown, back, ahead = shown + 1, back + 1, ahead - 1
            rows.append((shown, back, ahead))
        for name, column in zip(("version", "undoable", "redoable"), zip(*rows)):
            t = t.append_column(name, pa.array(column, pa.int64()))
        return t

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return log.groupBy(*document).applyInArrow(run, f"{kinds}, version long, undoable long, redoable long")


def dirty(now: DataFrame, saved: DataFrame, document: list[str]) -> DataFrame:
    """Documents whose rows differ from what was saved, either way."""
    return now.exceptAll(saved).unionByName(saved.exceptAll(now)).select(*document).distinct()


def stamp_date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("'%02d.%02d.%02d", year % 100, month, day)


def stamp_parts(date: Column) -> list[Column]:
    """Prefix, year, month, day."""
    return [F.regexp_extract(date, r"^(')?(\d+)\.(\d+)\.(\d+)$", k) for k in (1, 2, 3, 4)]


def draw_mode(frame: Column, fill: Column) -> Column:
    return F.when(frame & fill, 2).when(fill, 1).otherwise(0)


def box_size(kind: Column, w: Column, h: Column, text_w: Column, text_h: Column) -> list[Column]:
    """A box without a size gets its text's, or a stamp's; others are 100 at least."""
    none = (w <= 0) | (h <= 0)
    size = lambda own, text: F.when(none & (kind == "stamp"), 1800.0).when(none & kind.isin("text", "sticky"), text).otherwise(F.greatest(own.cast("double"), F.lit(100.0)))
    return [size(w, text_w), size(h, text_h)]
