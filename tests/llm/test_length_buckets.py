"""Boundaries against all choices, batches against their rules."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import length_buckets as lb, queries

SF = "/root/testdata/sf0.001"


def padding(bounds, lengths, numbers):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, numbers))


def test_boundaries_are_the_best():
    draw = random.Random(1)
    for _ in range(150):
        lengths = draw.sample(range(1, 40), draw.randint(1, 8))
        numbers = [draw.randint(1, 30) for _ in lengths]
        k = draw.randint(1, 5)
        got = lb.best_boundaries(lengths, numbers, k)
        top = max(lengths)
        choices = [(*c, top) for n in range(k) for c in combinations([x for x in lengths if x != top], n)]
        assert len(got) <= k and got == sorted(got) and got[-1] == top
        assert padding(got, lengths, numbers) == min(padding(c, lengths, numbers) for c in choices)
    assert lb.best_boundaries([], [], 3) == []


def check(rows, texts_tokens, window, budget):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        assert 1 <= r.tokens <= min(window, r.bucket_tokens) and r.padding == r.bucket_tokens - r.tokens
    assert {i: sum(r.tokens for r in rs) for i, rs in pieces.items()} == {i: n for i, n in texts_tokens.items() if n}
    for rs in pieces.values():
        rs.sort(key=lambda r: r.piece)
        assert [r.start for r in rs] == [window * i for i in range(len(rs))] and all(r.tokens == window for r in rs[:-1])
    buckets = defaultdict(lambda: defaultdict(list))
    for r in rows:
        buckets[r.bucket, r.bucket_tokens][r.batch].append(r.position)
    assert len({b for b, _ in buckets}) == len(buckets)
    for (_, length), batches in buckets.items():
        room = max(1, budget // length)
        assert sorted(batches) == list(range(len(batches)))
        assert all(sorted(p) == list(range(len(p))) and len(p) <= room for p in batches.values())
        assert all(len(batches[b]) == room for b in range(len(batches) - 1))


def test_query_is_whole_and_best(spark):
    rows = queries.op3_length_buckets(spark, SF).withColumnRenamed("doc_id", "id").collect()
    texts = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(rows, texts, lb.WINDOW, lb.BUDGET)
    counts = defaultdict(int)
    for r in rows:
        counts[r.tokens] += 1
    bounds = lb.best_boundaries(list(counts), list(counts.values()), lb.BUCKETS)
    assert sorted({r.bucket_tokens for r in rows}) == bounds
    assert sum(r.padding for r in rows) == padding(bounds, list(counts), list(counts.values()))


def test_small_windows_and_odd_rows(spark):
    data = [(1, "a b c d e f g h i j k"), (2, None), (3, ""), (4, " \t\n"), (5, "x"), (None, "p q"), (6, "w " * 1000)]
    frame = spark.createDataFrame([(*d, 9) for d in data], "doc_id bigint, text string, bucket int")
    rows = lb.length_buckets(frame, window=4, buckets=2, budget=9).collect()
    check(rows, {1: 11, 5: 1, None: 2, 6: 1000}, 4, 9)
    assert lb.length_buckets(frame.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        lb.length_buckets(frame, window=0)


def test_repeated_rows_and_own_lengths(spark):
    frame = spark.range(1000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(30).alias("n"))
    rows = lb.length_buckets(frame, length=F.col("n"), window=100, budget=300).collect()
    assert len(rows) == 1000 and {(r.batch, r.position) for r in rows} == {(i // 10, i % 10) for i in range(1000)}
