"""Shards of near equal bytes, gapless slots, cuts that follow the tree."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfrank.llm import kd_shards as kd, queries

SF = "/root/testdata/sf0.001"


def by_shard(rows):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return shards


def test_query_law(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_kd_shards(spark, SF).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    held = [sum(r.size for r in s) for s in by_shard(rows).values()]
    largest = max(r.size for r in rows)
    assert len(held) == 16 and max(held) - min(held) <= 4 * largest


def test_hot_metadata_and_uneven_counts(spark):
    frame = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"), F.lit(None).cast("string").alias("lang"),
    )
    for n in (1, 3, 5, 16):
        rows, tree = kd.kd_shards(frame, shards=n)
        rows = rows.collect()
        held = [sum(r.size for r in s) for s in by_shard(rows).values()]
        assert len(rows) == 6000 and len(held) == n and max(held) - min(held) <= 60
        assert sum(len([x for x in level if x.shards > 1]) for level in tree) == n - 1


def test_cuts_separate_the_widest_dimension(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("b"))
    rows, tree = kd.kd_shards(frame, by=("a", "b"), shards=2)
    ids = {s: sorted(r.id for r in held) for s, held in by_shard(rows.collect()).items()}
    assert tree[0][0].dimension == 1 and ids[0] == list(range(200)) and ids[1] == list(range(200, 400))


def test_target_bytes_and_odd_rows(spark):
    data = [(None, None, None, None), (1, "", "é", float("nan")), (1, "", "é", float("nan")), (2, "y" * 5000, "a", 1.0), (3, "z", "", float("inf"))]
    frame = spark.createDataFrame([(*d, 5) for d in data], "doc_id bigint, text string, lang string, source double, shard int")
    rows, _ = kd.kd_shards(frame, target_bytes=1000)
    rows = rows.collect()
    assert len(rows) == 5 and {(r.size, r.text_crc32) for r in rows if r.id is None} == {(1, 0)} and 0 <= max(r.shard for r in rows) <= 5
    by_shard(rows)
    empty, _ = kd.kd_shards(frame.filter(F.lit(False)), shards=4)
    assert empty.count() == 0


def test_texts_that_start_alike_are_told_apart(spark):
    """Sources that differ late, one of them far off the others, still make a dimension of full width."""
    names = ["https://a.com", "https://b.org", "https://b.org/second", "zzzz"]
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int")).alias("source"))
    rows, tree = kd.kd_shards(frame, by=("source",), shards=4)
    held = {s: {r.id % 4 for r in g} for s, g in by_shard(rows.collect()).items()}
    assert tree[0][0].dimension == 1 and held == {i: {i} for i in range(4)}


def test_ranks_count_bytes(spark):
    frame = spark.createDataFrame([("b", 5), ("a", 2), ("b", 1), (None, 9), ("é", 1), ("", 3)], "t string, size bigint")
    assert {r.value: r.rank for r in kd.text_ranks(frame, "t").collect()} == {"": 0.0, "a": 3.0, "b": 5.0, "é": 11.0}
