from pyspark.sql import functions as F

from shelfrank.functions.ranking import quantiles, stack_columns
from shelfrank.operators import catalog as cat


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def parsed(spark, text):
    df = spark.createDataFrame([("a", text)], "product_id string, product_features string")
    return cat.parse_features(df).first()


def test_parse_splits_at_first_colon_and_strips(spark):
    r = parsed(spark, " Primary Material :  oak : solid \t|junk|Style:\n modern ")
    assert r.material == ["oak : solid"] and r.style == ["modern"]
    assert r.color is None and r.countryoforigin is None


def test_parse_repeated_key_keeps_place_takes_last_value(spark):
    r = parsed(spark, "Color:red|Top Color:blue|Color:green")
    assert r.color == ["green", "blue"]


def test_parse_key_feeds_several_lists_and_ignores_case(spark):
    r = parsed(spark, "MATERIAL COLOR:tan|country of style:x")
    assert r.material == ["tan"] and r.color == ["tan"] and r.style == ["x"] and r.countryoforigin == ["x"]


def test_parse_null_and_empty(spark):
    assert parsed(spark, None).material is None
    assert parsed(spark, "").material is None
    assert parsed(spark, "style:").style == [""]


def test_filter_features_sorts_style_and_color_only(spark):
    text = "material b:2|material a:1|style x:z|style y:a|color:q|color 2:c|country:C"
    df = spark.createDataFrame([("a", text), ("b", "material:x")], "product_id string, product_features string")
    out = cat.filter_features(df).collect()
    assert len(out) == 1
    assert out[0].material == ["2", "1"] and out[0].style == ["a", "z"] and out[0].color == ["c", "q"]


LOOKUP = [("color", "black/white", ["black", "white"]), ("color", "matte black", ["black"]), ("color", "white", ["white"]), ("color", "x", ["X"])]


def test_normalize_methods_agree(spark):
    lookup = spark.createDataFrame(LOOKUP, "category string, raw string, normalized array<string>")
    data = [
        ("a", [" Matte Black", "white", "BLACK"]), ("b", ["black/white", "green"]), ("c", []), ("d", ["pink"]),
        ("e", ["black"]), ("f", ["X", "x"]), ("g", None),
    ]
    df = spark.createDataFrame(data, "product_id string, color array<string>")
    expected = [("a", ["black", "white"]), ("b", ["black", "white"]), ("c", []), ("d", []), ("e", ["black"]), ("f", ["X"]), ("g", [])]
    for method in ("inline", "join", "auto"):
        assert rows(cat.normalize_values(df, lookup, {"color": "color"}, method=method), "product_id", "color") == expected


def test_normalize_with_repeated_keys_and_ids(spark):
    """The last row of a repeated raw value counts, and rows that share an id keep their own values, both ways."""
    lookup = spark.createDataFrame([("color", "a", ["x"], 1), ("color", "a", ["y", "z"], 2), ("color", "b", ["x"], 3)], "category string, raw string, normalized array<string>, seq int")
    df = spark.createDataFrame([("1", ["A", "b"]), ("1", ["b"]), (None, ["a"]), ("1", ["b"]), ("2", [None, "a"])], "product_id string, color array<string>")
    expected = sorted([("1", ["y", "z", "x"]), ("1", ["x"]), (None, ["y", "z"]), ("1", ["x"]), ("2", ["y", "z"])], key=str)
    for method in ("inline", "join"):
        got = cat.normalize_values(df, lookup, {"color": "color"}, method=method).collect()
        assert sorted(((r.product_id, r.color) for r in got), key=str) == expected


def test_sample_is_the_smallest_hashes_at_any_size(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("product_id"))
    want = rows(cat.sample_n_sorted(df, 70), "product_id")
    monkeypatch.setattr(cat, "SLICE_ROWS", 1)
    assert len(want) == 70 and rows(cat.sample_n_sorted(df, 70), "product_id") == want


def test_fill_description_is_null_when_name_or_class_is(spark):
    schema = "product_id string, product_name string, product_class string, product_description string, color array<string>, style array<string>, material array<string>, countryoforigin array<string>"
    df = spark.createDataFrame(
        [("a", "n", "k", None, ["r", "b"], ["s"], [], ["c"]), ("b", None, "k", None, [], [], [], []), ("c", "n", "k", "own", [], [], [], [])], schema
    )
    got = dict(rows(cat.fill_description(df).fillna("<null>", ["product_description"]), "product_id", "product_description"))
    assert got == {"a": "n, k, r, b, s, , c", "b": "<null>", "c": "own"}


def test_impute_uses_mean_and_exact_median(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 4.0, 20.0), ("c", None, None), ("d", None, 1000.0), ("e", None, 40.0)], "product_id string, average_rating double, rating_count double")
    got = {r.product_id: r for r in cat.impute_mean_median(df).collect()}
    assert got["c"].average_rating == 2.5 and got["c"].rating_count == 30.0


def test_repair_edges(spark):
    df = spark.createDataFrame([("a", 2.9, 99.0), ("b", 3.0, 100.0), ("c", 5.0, 150.7), ("d", 1.0, 0.0)], "product_id string, average_rating double, rating_count double")
    got = {r.product_id: r for r in cat.repair_numeric(df).collect()}
    assert got["b"].average_rating == 3.0 and got["b"].rating_count == 100 and got["c"].rating_count == 150
    for k in "ad":
        assert 3.0 <= got[k].average_rating <= 5.0 and 100 <= got[k].rating_count <= 10000


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(5000).select(F.concat(F.lit("product_"), F.col("id")).alias("product_id"))
    for n in (0, 1, 777, 5000, 9999):
        a = [r[0] for r in cat.sample_n_sorted(df, n).collect()]
        b = [r[0] for r in cat.sample_n_sorted(df.repartition(7), n).collect()]
        assert a == b == sorted(a) and len(a) == min(n, 5000)


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).repartition(13).select(F.col("id").alias("v"), (F.col("id") % 10).alias("g"))
    got = {(r.g, r.v): int(r.product_id.split("_")[1]) for r in cat.assign_dense_ids(df, ["g", F.desc("v")]).collect()}
    expected = sorted(got, key=lambda k: (k[0], -k[1]))
    assert [got[k] for k in expected] == list(range(1, 1001))


def test_dedupe_keeps_last_and_drops_blank_ids(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 1, "n"), ("", 1, "m")], "product_id string, seq int, v string")
    assert rows(cat.dedupe_latest(df), "product_id", "v") == [("a", "z")]


def test_predict_class_fills_only_missing(spark):
    data = [(str(i), "red sofa" if i % 2 else "steel lamp", "text", ("sofa" if i % 2 else "lamp") if i < 30 else None) for i in range(34)]
    df = spark.createDataFrame(data, "product_id string, product_name string, product_description string, product_class string")
    got = {r.product_id: r.product_class for r in cat.predict_class(df, trees=5).collect()}
    assert len(got) == 34 and got["31"] == "sofa" and got["32"] == "lamp" and got["1"] == "sofa"
    full = df.filter("product_class is not null")
    assert cat.predict_class(full) is full


def test_unique_categories(spark):
    df = spark.createDataFrame([([" red", "", "blue "], "k"), (["red"], None), (None, " ")], "color array<string>, product_class string")
    assert rows(cat.unique_categories(df, ["color", "product_class"]), "category", "value") == [("color", "blue"), ("color", "red"), ("product_class", "k")]


def test_null_audit_and_stringify(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, "x", None)], "i int, s string, l array<string>")
    assert rows(cat.null_audit(df), "column_name", "nulls") == [("i", 0), ("l", 1), ("s", 1)]
    assert [r.text for r in cat.stringify_row(df, ["i", "s", "l"]).orderBy("i").collect()] == ["i: 1, s: None, l: ['a', 'b']", "i: 2, s: x, l: None"]


def test_quantiles_against_sorted_list(spark):
    import math

    values = [(-5.0,), (0.0,), (0.5,), (0.5,), (3.0,), (1e9,), (7.25,), (None,), (float("nan"),)] + [(float(i % 17),) for i in range(400)]
    df = spark.createDataFrame(values, "v double")
    clean = sorted(v for (v,) in values if v is not None and not math.isnan(v))
    points = {"0": 0.0, "25": 0.25, "50": 0.5, "75": 0.75, "90": 0.9, "100": 1.0}
    floor = {r.label: r.value for r in quantiles(stack_columns(df, ["v"]), points, False).collect()}
    mixed = {r.label: r.value for r in quantiles(stack_columns(df, ["v"]), points, True).collect()}
    for label, q in points.items():
        at = q * (len(clean) - 1)
        lo, hi = clean[math.floor(at)], clean[math.ceil(at)]
        assert floor[label] == clean[int(at)]
        assert abs(mixed[label] - (lo + (hi - lo) * (at - math.floor(at)))) < 1e-9


def test_training_rows_are_bounded_per_partition(spark):
    """A forest's rows are as wide as its features whatever their words: no partition holds more than the bytes allow."""
    df = spark.range(1000).coalesce(1)
    assert cat.training_rows(df, 64, 10) is df
    dealt = cat.training_rows(df, 64, 10, most_bytes=4 * 74 * 100).rdd.glom().map(len).collect()
    assert sum(dealt) == 1000 and len(dealt) == 10 and max(dealt) <= 150
