"""The corpus pipeline: language, quality, near duplicates, packing, each stage over all that the one before kept.

Each stage takes any table with the columns of ``documents``, extra ones with clashing names too, decides
by row and gives the rows it keeps with all their columns; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import langid, near_dups, packing, quality
from pagelake.llm.common import cut, free_since, numbered, ship, table, tables_so_far, tokenizer_path, unused

#: Score below which the quality stage rejects a text.
LEAST_QUALITY = 0.5
SEQUENCE = 2048
#: Words whose ids a worker of the packing stage keeps; it shares an executor with what the stages before left.
WORDS = 120_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no learned language: null, without a letter, or less like the nearest prototype than labelled texts of their length.

    Learns from the rows whose ``lang`` is not null; where there are none, all rows go. Equal texts have
    equal decisions, so repeated rows stay or go together; whole texts count, however long.
    """
    ship(spark)
    labelled = docs.select("doc_id", "text", "lang")
    profiles = langid.learned(labelled)
    return docs.filter(langid.like(profiles, langid.learned_least(labelled, profiles)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the model of the labelled rows among ``docs`` scores below LEAST_QUALITY.

    Null texts count as empty ones, which get a score; without labels of both kinds all texts have one
    score. Equal texts have equal decisions, so repeated rows stay or go together.
    """
    ship(spark)
    model = quality.learned(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.filter(quality.scored(model) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, similarity 0.8): that of the smallest doc_id.

    Rows are told apart by a number of their own, so rows of one doc_id are decided one by one: equal rows
    leave one, another text of the same id stays. A null id comes after all others; among equal ids the
    first row written counts. Null texts and texts without words are near nothing, and all stay.
    """
    own = unused("_row", docs.columns)
    rows = numbered(docs, own)
    marked = cut(near_dups.near_components(rows, words=5, percent=80, key=own).select(F.col("doc_id").alias("row"), "component_id", "kept"))
    several = marked.filter("not kept").select("component_id").distinct()
    members = marked.join(several, "component_id").join(rows.select(F.col(own).alias("row"), "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    dropped = cut(members.select("row", "component_id").join(first, "component_id").filter("row <> first.row").select(F.col("row").alias(own)))
    return rows.join(dropped, own, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each with its sequence and its place there.

    A null or empty text is the closing id alone; a long one is cut into whole sequences and a rest;
    repeated rows and null ids are pieces of their own.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE, WORDS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models, token ids and packing have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = tables_so_far()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            free_since(mark, docs)
    return docs
