"""Relations derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Lineitems as objects: file, page (the order), place and size in 1/100 mm, a record kind.
SHAPES = """
select l_orderkey % 40 as file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey*37) % 21000 as x, (l_suppkey*53) % 29700 as y,
 100 + cast(l_quantity as bigint)*10 as w, 100 + cast(l_quantity as bigint)*7 as h, 90*(l_linenumber % 4) as rotation,
 case when l_returnflag = 'A' then 32785 when l_returnflag = 'N' then 32829 else 32819 end as kind from lineitem
"""

#: The object tree: root, page list, pages, placements, objects; rec_no in tree order.
RECORDS = f"""
select file_id, cast(row_number() over (partition by file_id order by k1, k2, k3, k4, depth) - 1 as bigint) as rec_no, depth, kind, num, x, y, w, h, rotation from (
 select distinct file_id, cast(-2 as bigint) as k1, 0 as k2, cast(0 as bigint) as k3, cast(0 as bigint) as k4, 0 as depth, 49171 as kind, cast(0 as bigint) as num, cast(0 as bigint) as x, cast(0 as bigint) as y, cast(0 as bigint) as w, cast(0 as bigint) as h, 0 as rotation from ({SHAPES}) a
 union all select distinct file_id, cast(-1 as bigint), 0, cast(0 as bigint), cast(0 as bigint), 1, 4867, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), 0 from ({SHAPES}) b
 union all select distinct file_id, l_orderkey, 0, cast(0 as bigint), cast(0 as bigint), 2, 4865, l_orderkey % 1000, cast(0 as bigint), cast(0 as bigint), cast(21000 + (l_orderkey % 3)*4700 as bigint), cast(29700 + (l_orderkey % 3)*6700 as bigint), 0 from ({SHAPES}) c
 union all select file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, 3, 4866, cast(0 as bigint), x, y, w, h, 0 from ({SHAPES}) d
 union all select file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, 4, kind, cast(l_linenumber as bigint), cast(0 as bigint), cast(0 as bigint), w, h, rotation from ({SHAPES}) e) z
"""

WORDS_SPARK = "select doc_id, line_no, word_no, word from (select doc_id, line_no, line from documents lateral view posexplode(split(text,'\\n',-1)) a as line_no,line) lateral view posexplode(split(line,' ',-1)) b as word_no,word"
WORDS_DUCK = "select doc_id, line_no, unnest(range(len(w)))::int as word_no, unnest(w) as word from (select doc_id, line_no, string_split(line,' ') w from (select doc_id, unnest(range(len(l)))::int as line_no, unnest(l) as line from (select doc_id, string_split(text,chr(10)) l from documents)))"


def runs(words: str) -> str:
    """A text run for each word: half-width characters of 200, gaps of 300 (a space) or 200 at each fifth word."""
    return f"""
select doc_id, line_no, word_no, word as text, 400 as size, 2000+500*line_no as y,
 1000 + 200*coalesce(sum(length(word)+1) over (partition by doc_id,line_no order by word_no rows between unbounded preceding and 1 preceding),0) + 100*(word_no - cast(floor(word_no/5.0) as int)) as x
from ({words}) w
"""


RUNS_SPARK, RUNS_DUCK = runs(WORDS_SPARK), runs(WORDS_DUCK)

#: Definitions (supplier: name number -> name) and attributes (lineitem) of records.
DEFS = "select s_suppkey % 40 as file_id, s_suppkey as tag, s_name as name from supplier"
ATTRS = "select l_suppkey % 40 as file_id, l_orderkey as rec_no, l_linenumber as attr_no, l_suppkey as tag, l_partkey as value from lineitem"

#: Entries (parts) and references to them (all lineitems, to every third entry, so that the others are garbage).
ENTRIES = "select p_size as file_id, p_partkey as entry_no, 100 + length(p_name) as len from part"
REFS = "select p_size as file_id, l_orderkey as rec_no, l_linenumber as attr_no, p_partkey as entry_no from lineitem join part on p_partkey = l_partkey - l_partkey % 3 + 1"

#: Binders (conversations) of documents (turns) with page counts.
BINDERS = "select conv_id as binder, turn as doc_no, concat('doc ', role) as name, case when role = 'system' then 0 else 1 + length(text) % 5 end as pages from conversations"


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(sql)
