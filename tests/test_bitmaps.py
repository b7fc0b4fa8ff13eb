"""Bitmap conditions against the pair join: odd values, kept index, words instead of products."""

import random

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import bitmaps, filters
from shelfrank.session import materialize

PRODUCT = "product_id string, product_class string, color array<string>, material array<string>, style array<string>, price double, average_rating double, rating_count long"
QUERY = (
    "query_id string, product_class string, color array<string>, color_negated array<string>, material array<string>, material_negated array<string>, "
    "style array<string>, style_negated array<string>, price_max double, rating_min double, rating_count_min double"
)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(3)
    some = lambda words: draw.choice([None, [], [draw.choice(words)], [draw.choice(words), draw.choice(words), None]])
    colors, materials, styles = ["red", "blue", "green", "RED"], ["oak", "steel"], ["modern", "rustic", "glam"]
    price = lambda: draw.choice([None, float("nan"), 0.0, -0.0, 5.0, 12.5, 99.99, 100.0])
    products = [(f"p{i}", draw.choice(["Sofa", "Corner Sofa", "Lamp", None, ""]), some(colors), some(materials), some(styles), price(), draw.choice([None, 1.0, 4.5, 5.0]), draw.choice([None, 0, 10, 200])) for i in range(700)]
    products += [products[0], (None, "Sofa", ["red"], None, None, 5.0, 5.0, 10)]
    queries = [
        (f"q{i}", draw.choice([None, "", "sofa", "LAMP", "nothing"]), some(colors), some(colors), some(materials), some(materials), some(styles), some(styles), draw.choice([None, None, 0.0, 12.5, 50.0, -1.0]), draw.choice([None, None, 4.5]), draw.choice([None, None, 10.0]))
        for i in range(150)
    ]
    queries += [("none", None, *[None] * 6, None, None, None), ("class", "sofa", *[None] * 6, None, None, None), ("nan", None, *[None] * 6, float("nan"), None, None)]
    return spark.createDataFrame(products, PRODUCT), spark.createDataFrame(queries, QUERY)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"absent": "truthy"}, {"absent": "null_only", "class_text": True}, {"class_text": True}])
def test_same_rows_as_the_pair_join(tables, options):
    want = rows(filters.param_filter(*tables, **options))
    assert rows(bitmaps.bitmap_filter(*tables, **options)) == want and len(want) > 1000


def test_one_row_a_word(tables):
    products, queries = tables
    index = materialize(bitmaps.bitmap_index(products))
    n = products.count()
    assert index.count() == -(-n // 64) and index.agg(F.sum(F.bit_count("bits"))).first()[0] == n
    met = bitmaps.bitmap_hits(index, queries)
    assert met.groupBy("query_id", "word").count().filter("count > 1").isEmpty()
    assert rows(bitmaps.bitmap_filter(products, queries, index=index)) == rows(filters.param_filter(products, queries))


def test_slices_grow_with_the_index(tables, monkeypatch):
    monkeypatch.setattr(bitmaps, "SLICE", 2)
    assert rows(bitmaps.bitmap_filter(*tables)) == rows(filters.param_filter(*tables))


def test_empty_tables(tables):
    products, queries = tables
    none = F.lit(False)
    assert bitmaps.bitmap_filter(products.filter(none), queries).count() == 0 and bitmaps.bitmap_filter(products, queries.filter(none)).count() == 0
