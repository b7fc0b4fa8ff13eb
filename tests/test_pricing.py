import pytest
from pyspark.sql import functions as F

from checks.fixtures import thresholds_frame, weights_frame
from shelfrank.operators import pricing as pr


@pytest.mark.parametrize(
    "price, expected",
    [(2.5, 0.0), (7.5, 10.0), (97.5, 100.0), (99.99, 100.0), (100.0, 100.0), (112.5, 100.0), (137.5, 150.0), (999.0, 1000.0), (1000.0, 1000.0), (1050.0, 1000.0), (1150.0, 1200.0)],
)
def test_round_price_half_to_even(spark, price, expected):
    assert spark.range(1).select(pr.round_price(F.lit(price))).first()[0] == expected


def test_rating_multiplier_edges(spark):
    df = spark.createDataFrame([(r,) for r in (None, 0.2, 2.5, 2.75, 3.0, 3.5, 4.0, 4.5, 5.0, 7.0)], "average_rating double")
    df = df.withColumns({c: F.array().cast("array<string>") for c in ("material", "style")}).withColumn("product_id", F.lit("x"))
    got = [r.rating_multiplier for r in pr.add_multipliers(df, weights_frame(spark), thresholds_frame(spark)).collect()]
    assert got == [1.0, 0.85, 0.85, 0.85, 1.0, 1.0, 1.1, 1.25, 1.25, 1.25]


def products(spark):
    return spark.createDataFrame(
        [("a", ["Glass", "nothing", "wood"], ["x"], ["Italy"], 4.6, "K"), ("b", [], None, [], None, "K"), ("c", ["foam"], ["glam"], ["Mars"], 1.0, "none")],
        "product_id string, material array<string>, style array<string>, countryoforigin array<string>, average_rating double, product_class string",
    )


def test_attribute_multipliers(spark):
    got = {r.product_id: r for r in pr.add_multipliers(products(spark), weights_frame(spark), thresholds_frame(spark), "countryoforigin").collect()}
    assert got["a"].material_multiplier == pytest.approx((1.3 + 1.05) / 2 + 0.1)
    assert got["a"].style_multiplier == pytest.approx(0.1)  # nothing known
    assert got["a"].country_multiplier == pytest.approx(1.3)
    assert got["b"].material_multiplier == got["b"].style_multiplier == got["b"].country_multiplier == 1.0
    assert got["c"].country_multiplier == pytest.approx(0.1)


def test_joined_multipliers_agree(spark):
    args = (products(spark), weights_frame(spark), thresholds_frame(spark), "countryoforigin", True)
    names = ["product_id", "material_multiplier", "style_multiplier", "country_multiplier", "rating_multiplier"]
    a = sorted(tuple(r) for r in pr.add_multipliers(*args).select(*names).collect())
    b = sorted(tuple(r) for r in pr._add_multipliers_joined(*args).select(*names).collect())
    for x, y in zip(a, b):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])


def test_repeated_ids_items_and_null_items(spark):
    """Both ways agree where ids, items of a list or items of the table repeat, and where items are null."""
    rows = [("a", ["wood", "wood", None], ["glam"], 4.0), ("a", [None], [], None), ("a", ["glass"], None, 4.0), (None, ["wood"], ["x"], 2.0), ("a", ["glass"], None, 4.0)]
    df = spark.createDataFrame(rows, "product_id string, material array<string>, style array<string>, average_rating double")
    weights = spark.createDataFrame([("material", "wood", 2.0, 1), ("material", "wood", 1.5, 2), ("material", "glass", 1.0, 1), ("style", "glam", 1.1, 1)], "feature_type string, item string, weight double, seq int")
    names = ["product_id", "material_multiplier", "style_multiplier", "rating_multiplier"]
    want = [("a", 1.6, 1.2, 1.1), ("a", 0.1, 1.0, 1.0), ("a", 1.1, 1.0, 1.1), (None, 1.6, 0.1, 0.85), ("a", 1.1, 1.0, 1.1)]
    for made in (pr.add_multipliers(df, weights, thresholds_frame(spark)), pr._add_multipliers_joined(df, weights, thresholds_frame(spark), None, True)):
        got = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in made.select(*names).collect()), key=str)
        assert got == sorted(want, key=str)


def test_add_prices_bounds_and_missing_class(spark):
    ranges = spark.createDataFrame([("K", 100.0, 400.0)], "product_class string, price_min double, price_max double")
    got = {r.product_id: r.price for r in pr.add_prices(products(spark), ranges, weights_frame(spark), thresholds_frame(spark)).collect()}
    assert got["c"] is None
    # multiplier 1: mean 250, deviation 50
    assert got["b"] == 275.0
    # material 1.275 x style 0.1 x rating 1.25 is raised to 0.3
    assert got["a"] == 80.0
    counters = pr.pricing_counters(products(spark), ranges).first()
    assert tuple(counters) == (2, 1, 1, 1)


def test_confidence(spark):
    df = spark.createDataFrame([(None, 5.0), (4.0, None), (4.0, 0.0), (4.0, 50.0), (4.0, 500.0)], "r double, c double")
    assert [x[0] for x in df.select(pr.rating_confidence(F.col("r"), F.col("c"))).collect()] == [0.0, 0.5, 0.01, 0.5, 1.0]
