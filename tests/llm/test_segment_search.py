"""Exact top-k against SQL and brute force, bounds that never cut a winner."""

import numpy as np
from pyspark.sql import functions as F

from shelfrank.llm import queries, segment_search as ss
from tools.verify import compare, connect

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    out = {}
    for q, v in rows:
        if asked(q):
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {(q, r + 1): x for q, found in out.items() for r, x in enumerate(found)}


def test_query_matches_sql(spark):
    assert compare(queries.op7_segment_search(spark, SF), connect(SF), queries.ORACLES["op7_segment_search"]) == ""


def test_bounds_hold():
    draw = np.random.default_rng(1)
    for width in (1, 3, 16, 50):
        a, b = draw.normal(0, 90, (20, width)), draw.normal(5, 60, (30, width))
        for level in ss.LEVELS:
            x, y = ss.statistics(a, level), ss.statistics(b, level)
            near = ((x[:, None] - y[None]) ** 2).sum(2)
            exact = ((a[:, None] - b[None]) ** 2).sum(2)
            assert (near <= exact * (1 + 1e-9) + 1e-6).all()


def test_blocks_ties_and_clusters(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (6, 24))
    data = [(i, [round(float(x), 3) for x in centres[i % 6] + draw.normal(0, 0.05, 24) * (i % 4 > 0)]) for i in range(900)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data]
    want = brute(rows, lambda i: i % 20 == 0, 7)
    for room in (4096, 100):
        got = ss.exact_topk(frame, F.col("id") % 20 == 0, 7, block_rows=room).collect()
        assert {(r.query_id, r.rank): (r.id, r.score) for r in got} == want and len(got) == len(want)


def test_large_numbers_are_exact():
    query, rows = np.array([2**40 + 1, -3]), np.array([[2**20 + 1, 5], [2**50, 7]])
    assert ss.exact_scores(query, rows) == [(2**40 + 1) * (2**20 + 1) - 15, 2**63 - 1]


def test_odd_rows(spark):
    data = [(0, [1.0, 0.0], 1), (50, [0.5, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (5, [], 1), (6, [0.25], 1), (50, [0.5, 0.5], 1), (7, [-1.0, 2.0], 1), (7, [-1.0, 2.0], 1)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, score int")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in ss.exact_topk(frame, F.col("id") % 50 == 0).collect()}
    assert got == {
        (0, 1): (50, 256 * 128), (0, 2): (6, 256 * 64), (0, 3): (5, 0), (0, 4): (7, -65536),
        (50, 1): (0, 256 * 128), (50, 2): (7, 128 * 256), (50, 3): (6, 128 * 64), (50, 4): (5, 0),
    }
    assert ss.exact_topk(frame.filter(F.lit(False)), F.col("id") % 50 == 0).count() == 0
    assert ss.exact_topk(frame.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_one_common_vector(spark):
    frame = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    got = ss.exact_topk(frame, F.col("id") % 500 == 0, block_rows=700).collect()
    assert {r.query_id: None for r in got}.keys() == set(range(0, 3000, 500))
    assert all([x.id for x in sorted((y for y in got if y.query_id == q), key=lambda y: y.rank)] == [i for i in range(6) if i != q][:5] for q in range(0, 3000, 500))
