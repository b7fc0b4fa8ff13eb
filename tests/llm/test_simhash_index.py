"""Fingerprints, the byte index and components against brute force."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfrank.llm import common, queries, simhash_index as si

SF = "/root/testdata/sf0.001"


def plain_simhash(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_simhash(d.text, 3) for d in docs]
    roots = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_index(spark, SF).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots)}


def test_links_are_complete_for_close_fingerprints(spark):
    draw = random.Random(3)
    prints = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    prints |= {0, (1 << 64) - 1, 1 << 63, 7}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    got = [(r.a, r.b) for r in si.links(frame).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_every_five_positions_hold_a_set():
    assert len(si.QUADS) == 14
    assert all(any(set(q) <= set(five) for q in si.QUADS) for five in combinations(range(8), 5))
    with pytest.raises(ValueError):
        si.links(None, 4)


def test_long_chain_and_star_become_one_component(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}


def test_odd_rows(spark):
    rows = [(None, None, 1), (3, "", 2), (2, " \n", 3), (4, "One two", 4), (9, "ONE TWO", 5), (9, "ONE TWO", 5), (7, "x " * 60000, 6), (None, "lone words here", 7), (None, "lone words here", 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted(((r.id, r.component_id) for r in si.near_groups(frame).collect()), key=str)
    assert got == sorted([(None, 2), (3, 2), (2, 2), (4, 4), (9, 4), (9, 4), (7, 7), (None, None), (None, None)], key=str)
    kept = si.one_per_group(frame)
    assert kept.columns == frame.columns
    assert sorted(kept.collect(), key=str) == sorted([frame.collect()[i] for i in (2, 3, 6, 7)], key=str)
    empty = frame.filter(F.lit(False))
    assert si.near_groups(empty).count() == 0 and si.one_per_group(empty).count() == 0


def test_many_copies_enter_the_index_once(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words in all of these rows").alias("text"))
    got = si.near_groups(copies).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in got] == [(0, 3000)]
