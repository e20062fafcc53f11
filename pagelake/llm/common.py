"""What the training-data operators share: shared storage, module shipping, gapless ranks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.session import ship as ship  # re-exported for the operators

#: Rows of one key that a single window group holds at most, about.
RANK_GROUP = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(sc, "_pagelake_dir", None)
        if folder is None:
            folder = sc._pagelake_dir = tempfile.mkdtemp(prefix="pagelake-shared-")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which cuts its lineage.

    A lost executor then costs a reread of files, never a second run of the Python stage before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagelake_path = path
    _tables.append(out)
    return out


_tables: list[DataFrame] = []


def tables_so_far() -> int:
    """How many tables this driver has written; a mark for ``free_since``."""
    return len(_tables)


def free_since(mark: int, *but: DataFrame) -> None:
    """Remove the tables written after the mark, ``but`` those named."""
    free(*(t for t in _tables[mark:] if all(t is not b for b in but)))
    _tables[mark:] = but


#: Files whose numbers ``numbered`` broadcasts at most, about 20 MB of paths; rows of more files are written with theirs.
MOST_FILES = 100_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a whole number ``name`` of each row that stays the same however often the rows are read.

    Rows of a Parquet table are numbered by their file and their place in it, so nothing is written;
    rows of anything else, and of tables of more than MOST_FILES files, are written with a number.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
        relation = plan.relation()
        if relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and relation.location().rootPaths().size() == 1:
            place = df.metadataColumn("_metadata")
            paths = sorted(r[0] for r in df.select(place["file_path"]).distinct().limit(MOST_FILES + 1).collect())
            if len(paths) <= MOST_FILES:
                file, first = (unused(x, [*df.columns, name]) for x in ("_file", "_first"))
                firsts = df.sparkSession.createDataFrame([(x, k << 40) for k, x in enumerate(paths)], f"{file} string, {first} long")
                found = df.select("*", place["file_path"].alias(file), place["row_index"].alias(name)).join(F.broadcast(firsts), file)
                return found.withColumn(name, F.col(first) + F.col(name)).select(*(F.col(f"`{c}`") for c in df.columns), name)
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def free(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._pagelake_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def small_key_counts(df: DataFrame, key: str, limit: int) -> dict[int, int]:
    """Rows by key, for a key of at most ``limit`` values; more raise ValueError."""
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{key} has more than {limit} values")
    return {r[key]: r["n"] for r in rows}


def gapless_rank(df: DataFrame, key: str, counts: dict[int, int], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, without gathering a key in one task.

    ``counts`` has the rows of each key (few keys). A key is dealt over ceil(rows / RANK_GROUP)
    buckets by a hash of ``order``; rows are numbered in their bucket and moved by the sizes of the
    buckets before. The numbers depend on the rows alone, so a stage that runs again gives the same;
    rows that tie in all of ``order`` should be equal, as they may change places.
    """
    spark = df.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // RANK_GROUP)) for k, n in counts.items()] or [(0, 1)], f"{key} {df.schema[key].dataType.simpleString()}, _of int")
    dealt = df.join(F.broadcast(buckets), key).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_of").cast("long"))).drop("_of")
    sizes = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(moved, [key, "_bucket"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in")


def chunks(items: Iterable, size: int) -> Iterator[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def parts_by_size(texts: pa.Array) -> Iterator[list]:
    """The texts as lists of about two million bytes, a longer one alone."""
    for b in by_size(pa.RecordBatch.from_arrays([texts], ["t"]), 0):
        yield b.column(0).to_pylist()


def by_size(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together, a longer one alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_kept: dict = {}


def kept(key: tuple, make):
    """A worker's table that outlives a batch. One is kept at a time: workers are used again by other
    stages, which must not pay for the memory of those before."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for this worker alone."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores after it until no column has it (Spark does not tell letter case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``keep`` and the text, sent once; and the place of the text."""
    if text in keep:
        return df.select(*(F.col(f"`{k}`") for k in keep)), keep.index(text)
    return df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias(unused("_text", keep))), len(keep)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: the folder in PAGELAKE_TOKENIZERS, else the installed package."""
    folder = os.environ.get("PAGELAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
