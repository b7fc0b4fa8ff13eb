"""Hard negatives against SQL and brute force; scans that shrink, blocks, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from shelfrank.llm import bond_scan as bs, queries
from tools.verify import compare, connect

SF = "/root/testdata/sf0.01"


def brute(rows, asked, k, m):
    out = []
    for a, label, v in rows:
        if asked(a):
            scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a)
            for s, p, other in [x for x in scores if x[2] == label][:k]:
                fits = [(i, -n) for n, i, o in scores if o != label and 30 * -s <= 100 * -n <= 90 * -s]
                out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(fits[:m])]
    return sorted(out)


def ints(rows):
    return [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows]


def test_query_matches_sql(spark):
    assert compare(queries.op13_bond_scan(spark, SF), connect(SF), queries.ORACLES["op13_bond_scan"]) == ""


def test_clusters_ties_and_blocks(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(0.3, 1, (6, 24))
    rows = [(i, int(draw.integers(0, 4)), [round(float(x), 3) for x in centres[i % 6] * (0.4 + 0.6 * (i % 5 > 0)) + draw.normal(0, 0.05, 24) * (i % 4 > 0)]) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    want = brute(ints(rows), lambda i: i % 25 == 0, 3, 4)
    for room in (4096, 90):
        assert sorted(tuple(r) for r in bs.hard_negatives(frame, F.col("id") % 25 == 0, 3, 4, block_rows=room).collect()) == want and want


def test_bitmap_shrinks_and_bounds_hold():
    draw = np.random.default_rng(4)
    data = draw.integers(-40, 40, (3000, 64)) * (np.arange(64) < 12)
    block = bs.Block(range(3000), np.zeros(3000, int), list(data), 64)
    anchor, seen = data[0] * 3, []

    def shrink(places, lower, upper):
        exact = data[places] @ anchor
        assert (lower <= exact).all() and (exact <= upper).all()
        stay = upper >= bs.reached(lower, 5)
        seen.append(int(stay.sum()))
        return stay

    places, scores = bs.scan(block, anchor, np.ones(3000, bool), shrink)
    assert min(seen) < 200 and len(places) < 200 and (scores == data[places] @ anchor).all()
    assert set(np.argsort(-(data @ anchor))[:5]) <= set(places)


def test_large_numbers_are_exact():
    vectors = [[2**40 + 1, 3], [2**40, 7], [5, 2**33]]
    block = bs.Block([1, 2, 3], [0, 0, 0], vectors, 2)
    got = list(bs.positives(block, 9, 0, np.array([2**20 + 1, -3]), 3))
    assert got == sorted(((i + 1, (2**20 + 1) * a - 3 * b) for i, (a, b) in enumerate(vectors)), key=lambda x: -x[1])


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.5], 1), (1, 1, [1.0, 0.25], 1), (1, 1, [1.0, 0.25], 1), (1, 2, [9.0, 9.0], 1), (2, 2, [0.5, 0.5], 1), (3, 2, [0.5, 0.5], 1), (4, None, [1.0, 1.0], 1), (5, 2, None, 1), (6, 2, [1.0, None], 1),
        (7, 2, [float("nan"), 1.0], 1), (8, 2, [float("inf")], 1), (None, 2, [0.5, 0.5], 1), (9, 2, [0.5], 1), (10, 2, [], 1), (100, 3, [1.0], 1), (200, 2, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, id int")
    kept = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (9, 2, [0.5]), (10, 2, []), (100, 3, [1.0]), (200, 2, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in bs.hard_negatives(frame, F.col("id") % 100 == 0).collect())
    assert got == brute(ints(kept), lambda i: i % 100 == 0, 5, 10) and got
    assert bs.hard_negatives(frame.filter(F.lit(False)), F.col("id") % 100 == 0).count() == 0
    assert bs.hard_negatives(frame.filter("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


def test_one_common_vector(spark):
    frame = spark.range(2000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.5))).alias("embedding"))
    got = bs.hard_negatives(frame, F.col("id") % 500 == 0, block_rows=300).collect()
    assert {r.anchor_id for r in got} == {0, 500, 1000, 1500}
    assert all(r.negative_id == 2 * r.rank - 1 for r in got) and {r.positive_id for r in got if r.anchor_id == 0} == {2, 4, 6, 8, 10}
