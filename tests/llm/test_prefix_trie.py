"""The trie of prefixes and its rollup against brute force; deep, wide and odd tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import prefix_trie as pt, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    made, nodes, kids, leaves, saved = {}, {}, {}, {}, {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
        for d in range(len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
        saved[k] = (len(nodes[k]) - 1) * words + sum(saved[x] for x in kids.get(k, []))
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, local=pt.LOCAL):
    conv = F.col("conv_id")
    made = pt.with_shared_starts(pt.ordered_turns(df), conv - conv % 20, F.crc32(conv.cast("string")) % 4)
    return sorted((tuple(r) for r in pt.prefix_trie(*made, local).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.op12_prefix_trie(spark, SF)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(map(tuple, rows))


def test_rounds_of_splits(spark, monkeypatch):
    """Shared, deep and bushy conversations, with components split by joins down to ``local`` nodes, and prefixes built in pieces."""
    monkeypatch.setattr(pt, "PIECE", 8)
    monkeypatch.setattr(pt, "ENDS", 3)
    draw = random.Random(3)
    rows = [(c, t, draw.choice("ua"), draw.choice(["x", "y y", "z z z"])) for c in range(60) for t in range(draw.randint(0, 4))]
    rows += [(c, t, "u", f"same {min(t, 30)}") for c in (100, 101, 140) for t in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert trie(frame, 12) == brute(rows)


def test_one_conversation_with_most_turns(spark):
    rows = [(5, t, "u", f"w{t % 3}") for t in range(3000)] + [(c, t, "u", "w0") for c in range(6, 60) for t in range(3)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5), 900) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "lost"), (0, None, None, None), (0, 1, "u", "a  b\tc"), (0, 1, "u", "a  b\tc"), (1, 1, "u", "a  b\tc"), (1, None, "", ""), (2, 2, "b", "t"), (2, 2, "a", "t"), (2, 2, "a", "s"),
        (21, 0, "u", "é" * 70000), (22, 5, "u", None), (-3, 1, "u", "neg"), (-40, 1, None, "neg"), (40, 0, "1", "2 u"), (41, 0, "12", " u"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "node": F.lit("x")})
    assert trie(frame, 6) == brute(rows)
    assert trie(frame.filter(F.lit(False))) == []
    assert trie(frame.filter("conv_id IS NULL")) == []


def test_memory_rollup_on_random_forests():
    draw = random.Random(5)
    for n in (0, 1, 2, 30, 400):
        parents = [-1 if i == 0 or draw.random() < 0.05 else draw.randrange(max(0, i - draw.choice([1, 3, 400])), i) for i in range(n)]
        values = [(draw.randint(0, 9), 1) for _ in range(n)]
        want = [list(v) for v in values]
        for i in range(n - 1, -1, -1):
            if parents[i] >= 0:
                want[parents[i]] = [x + y for x, y in zip(want[parents[i]], want[i])]
        assert pt.finish_forest(parents, values, 2) == want
