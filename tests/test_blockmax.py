"""Bounded term search against the plain search: rows, conditions, and how much of the table is scored."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import blockmax, textsearch
from shelfrank.session import materialize


@pytest.fixture(scope="module")
def tables(spark):
    """Documents about ten topics; words of one topic rarely stand elsewhere, some words stand everywhere."""
    draw = random.Random(5)
    texts, products = [], []
    for i in range(1500):
        topic = i % 10
        words = [f"t{topic}w{draw.randrange(12)}" for _ in range(draw.randint(3, 25))] + draw.choices(["the", "of", "and"], k=draw.randint(0, 4))
        texts.append((f"p{i:04d}", " ".join(words) if i % 50 else None))
        products.append((f"p{i:04d}", [draw.choice(["red", "blue"])], None, None, float(draw.randrange(100)), draw.choice([None, 4.0, 5.0]), 10))
    asked = [(f"q{i}", f"t{i % 10}w{draw.randrange(12)} t{i % 10}w{draw.randrange(12)} the", draw.choice([None, ["red"]]), draw.choice([None, 50.0])) for i in range(40)]
    asked += [("empty", "", None, None), ("null", None, None, None), ("unknown", "zzz", None, None), ("common", "the of and", None, None), ("none fits", "the", ["pink"], None)]
    return (
        spark.createDataFrame(texts, "product_id string, text string"),
        spark.createDataFrame(asked, "query_id string, query_text string, color array<string>, price_max double"),
        spark.createDataFrame(products, "product_id string, color array<string>, material array<string>, style array<string>, price double, average_rating double, rating_count long"),
    )


def rows(df):
    return sorted((r.query_id, r.position, r.product_id, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 10, 2000])
def test_same_rows_as_the_plain_search(tables, n):
    texts, asked, products = tables
    want = rows(textsearch.sparse_topk(texts, asked, n))
    assert rows(blockmax.bounded_topk(texts, asked, n, block=16)) == want and want


def test_conditions(tables):
    texts, asked, products = tables
    want = rows(textsearch.sparse_topk(texts, asked, 7, products=products))
    assert rows(blockmax.bounded_topk(texts, asked, 7, products=products, block=16)) == want and want


def test_few_blocks_are_scored(spark, tables):
    texts, asked, _ = tables
    terms = materialize(textsearch.query_terms(asked))
    postings = materialize(blockmax.blocked(textsearch.asked_weights(textsearch.one_field(texts), terms, F.broadcast), 16))
    made = blockmax.bounded_scores(postings, terms, 5, block=16)
    every, looked = made.bounds.count(), made.first.count() + made.then.count()
    pairs, scored = postings.join(terms, "term").select("query_id", "product_id").distinct().count(), made.scores.count()
    assert looked < every / 2 and scored < pairs / 2
    # A bound is never below the score of a document of its block.
    best = postings.join(terms, "term").groupBy("query_id", "block", "product_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    assert best.join(made.bounds, ["query_id", "block"]).filter("score > bound * (1 + 1e-9)").isEmpty()


def test_empty_tables(tables):
    texts, asked, _ = tables
    assert blockmax.bounded_topk(texts.filter("false"), asked, 5).count() == 0 and blockmax.bounded_topk(texts, asked.filter("false"), 5).count() == 0


def test_queries_with_the_same_known_words_are_searched_once(spark, monkeypatch):
    texts = spark.createDataFrame([(f"d{i:02d}", f"Brand#{i % 4} {i % 7}") for i in range(60)], "product_id string, text string")
    asked = spark.createDataFrame([(f"q{i:03d}", f"{i % 4} {i % 7} line{i}") for i in range(300)] + [(None, "3"), ("unknown", "zzz")], "query_id string, query_text string")
    want = rows(textsearch.sparse_topk(texts, asked.filter("query_id is not null"), 5))
    monkeypatch.setattr(blockmax, "MAX_BROADCAST_ROWS", 20)
    searched = []
    monkeypatch.setattr(blockmax, "bounded_scores", lambda postings, terms, *more, made=blockmax.bounded_scores: searched.append(terms) or made(postings, terms, *more))
    got = blockmax.bounded_topk(texts, asked, 5, block=16)
    assert rows(got) == want and want
    assert searched[0].select("query_id").distinct().count() == 22


def test_blocks_are_bounded_and_scored_where_they_are(spark, tables, monkeypatch):
    """Packed documents move to their block; neither postings nor pairs of a query and a document do, and slots that queries share add no rows."""
    texts, asked, _ = tables
    want = rows(textsearch.sparse_topk(texts, asked, 7))
    monkeypatch.setattr(blockmax, "MAX_SLOTS", 3)
    found = blockmax.bounded_topk(texts, asked, 7, block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(block" in plan and not re.search(r"Exchange hashpartitioning\((block#\d+L?, term|query_id#\d+, (block|product_id))", plan)
    assert rows(found) == want and want
