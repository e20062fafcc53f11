"""The corpus pipeline's stages against brute-force versions over whole small tables."""

import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from pagelake.llm import langid, quality
from pagelake.llm.common import numbered, table, tokenizer_path

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_groups(texts, n=5, percent=80):
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    out = defaultdict(list)
    for i in range(len(texts)):
        out[find(i)].append(i)
    return list(out.values())


def test_run_gives_what_the_stages_give_one_by_one(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    profiles = langid.learned(docs.select("doc_id", "text", "lang"))
    least = langid.learned_least(docs.select("doc_id", "text", "lang"), profiles)
    kept = [r for r, ok in zip(rows, profiles.like([r.text for r in rows], least)) if ok]
    after = corpus_pipeline.language(spark, docs, SF)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in kept) and kept

    now = spark.createDataFrame(kept, docs.schema)
    model = quality.learned(now.select("doc_id", "text"), table(spark, SF, "labels").select("doc_id", "quality"))
    scores = [model.score(np.array([quality.features(r.text)]))[0] for r in kept]
    kept = [r for r, s in zip(kept, scores) if s >= corpus_pipeline.LEAST_QUALITY]
    assert sorted(r.doc_id for r in corpus_pipeline.quality_filter(spark, now, SF).collect()) == sorted(r.doc_id for r in kept) and kept

    kept = [min((kept[i] for i in g), key=lambda r: r.doc_id) for g in near_groups([r.text for r in kept])]
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for r in kept:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[r.doc_id, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("parts", [1, 3])
def test_near_duplicates_go_by_row(spark, parts):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [
        (3, long), (7, long), (7, "what nobody else has in this table at all"), (20, "z y x w v u t"), (20, "z y x w v u t"), (None, "z y x w v u t"), (None, long + " and"), (8, None), (8, None), (9, ""),
        (30, "of one id in two near texts, a b c d e f g h i j k l m n o p q r s t u v w x y z"), (30, "of one id in two near texts, a b c d e f g h i j k l m n o p q r s t u v w x y z too"), (None, "alone and without an id"),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 5) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int").repartition(parts)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    want = []
    for g in near_groups([t for _, t in rows]):
        want.append(min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)))
    tied = lambda x: [(k, t.removesuffix(" too")) for k, t in x]
    assert sorted(tied(got)) == sorted(tied((str(k), str(t)) for k, t in want))


def test_packing_takes_nulls_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string, piece string"
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, "word " * 5000, "x")], kind)
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert sorted(r.length for r in rows if r.doc_id != 2) == [1, 1, 1]
    assert sorted((r.piece, r.length) for r in rows if r.doc_id == 2) == [(0, 2048), (1, 2048), (2, 5001 - 4096)]
    assert corpus_pipeline.pack(spark, docs.limit(0), "").collect() == []


def test_rows_keep_their_numbers_however_often_a_table_is_read(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "odd")
    odd = spark.range(1000).select("id", F.lit("x").alias("_metadata"), F.lit("y").alias("_file"), F.lit("z").alias("_first"))
    odd.repartition(7).unionByName(odd.limit(0)).write.parquet(path)
    for docs in (spark.read.parquet(path), spark.read.parquet(path).filter("id < 500"), odd, spark.read.parquet(path, path), odd.limit(0)):
        rows = numbered(docs, "_row")
        assert rows.columns == [*docs.columns, "_row"]
        first = {r._row: r.id for r in rows.collect()}
        assert len(first) == docs.count() and first == {r._row: r.id for r in rows.coalesce(1).select("_row", "id").collect()}
        assert sorted(first.values()) == sorted(r.id for r in docs.collect())
        assert all((r._metadata, r._file, r._first) == ("x", "y", "z") for r in rows.collect())


def test_prototypes_and_least_cosines_come_from_all_rows(spark):
    """4000 equal texts of a language, and another text of it that a draw of 3000 leaves out or finds too seldom to count."""
    rows = [(k, f"the water runs under the old bridge {'q' * (k % 3)}", "en") for k in range(4000)] + [(k, "zzyzx kwyjibo vvvv", "en") for k in range(4000, 4060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    total = np.zeros(langid.DIM)
    for i, codes, counts in langid.trigrams([t for _, t, _ in rows]):
        v = langid.space(langid.DIM).vector(codes, counts).astype(float)
        total += v / np.linalg.norm(v)
    assert np.abs(profiles.prototypes[0] - total / np.linalg.norm(total)).max() < 1e-6
    by = defaultdict(list)
    for _, _, cos, length in profiles.nearest([x for _, t, _ in rows for x in langid.stretches(t)]):
        by[length].append(cos)
    least, so_far = langid.learn_least(docs, profiles), np.inf
    for n in sorted(by, reverse=True):
        low = np.quantile(by[n], 0.01)
        so_far = min(so_far, low / 2 if low > langid.NOISE / np.sqrt(langid.DIM) else 0.0)
        by[n] = so_far
    assert all(abs(least[0, n] - max(x for m, x in by.items() if m <= n)) < 1 / langid.STEPS for n in by) and max(by.values()) > 0
