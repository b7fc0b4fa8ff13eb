import json

from pyspark.sql import functions as F

from shelfrank.operators import filters
from shelfrank.sources import readers as rd, writers as wr


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_rows_and_rejects(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", '{"product_id": "a", "price": 2}', "", "  ", "{broken", '{"product_id": "b", "color": ["x"]}')
    good, bad = rd.scan_jsonl(spark, path)
    assert [(r.product_id, r.price, r.color) for r in good.orderBy("product_id").collect()] == [("a", 2.0, None), ("b", None, ["x"])]
    assert [r.line for r in bad.collect()] == ["{broken"]


def test_whole_numbers_with_a_fraction(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", '{"product_id": "a", "rating_count": 12.0}', '{"product_id": "b", "rating_count": 9007199254740993}', '{"product_id": "c", "rating_count": "many"}', '{"product_id": "d", "rating_count": null}')
    good, bad = rd.scan_jsonl(spark, path)
    assert {r.product_id: r.rating_count for r in good.collect()} == {"a": 12, "b": 9007199254740993, "d": None}
    assert dict(good.dtypes)["rating_count"] == "bigint" and [r.line for r in bad.collect()] == ['{"product_id": "c", "rating_count": "many"}']


def test_list_parameters_reach_the_filter(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"query_id": "a", "query_params": {"color": ["red", "blue"]}}, {"query_id": "b", "query_params": {"color": "red", "style_negated": []}}, {"query_id": "c", "query_params": {"color": None, "price_max": 1}}]))
    flat = rd.flatten_params(rd.scan_json_array(spark, str(q)))
    assert {r.query_id: (r.color, r.style_negated) for r in flat.collect()} == {"a": (["red", "blue"], None), "b": (["red"], []), "c": (None, None)}
    products = spark.createDataFrame([("r", ["red"]), ("b", ["blue"]), ("g", ["green"])], "product_id string, color array<string>").withColumns(
        {"material": F.array(F.lit("m")), "style": F.array(F.lit("s")), "product_class": F.lit("K"), "price": F.lit(5.0), "average_rating": F.lit(4.0), "rating_count": F.lit(1)})
    got = sorted((r.query_id, r.product_id) for r in filters.param_filter(products, flat).collect())
    assert got == [("a", "b"), ("a", "r"), ("b", "r")]


def test_tsv(spark, tmp_path):
    path = write(tmp_path / "p.csv", "product_id\tproduct_name\tproduct_class\tproduct_description\tproduct_features\trating_count\taverage_rating\treview_count", '1\ta "b"\t\td\tk : v|c:d\t10.0\t4.5\t')
    r = rd.scan_tsv(spark, path).first()
    assert r.product_name == 'a "b"' and r.product_class is None and r.product_features == "k : v|c:d" and r.rating_count == 10.0 and r.review_count is None


def test_json_array_and_result_map(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"query_id": "synth-001", "query_type": "synth", "query_text": "t", "query_params": {"product_class": "Hats", "price_max": 5}}], indent=2))
    r = rd.flatten_params(rd.scan_json_array(spark, str(q))).first()
    assert (r.query_id, r.product_class, r.price_max, r.style) == ("synth-001", "Hats", 5.0, None)
    m = tmp_path / "r.json"
    m.write_text(json.dumps({"synth-001": ["p1", "p2"], "synth-002": []}, indent=2))
    assert {x.query_id: x.product_ids for x in rd.scan_result_map(spark, str(m)).collect()} == {"synth-001": ["p1", "p2"], "synth-002": []}


def test_lookup_last_line_wins_and_lists(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", '{"raw": "a", "normalized": "x"}', '{"raw": "b", "normalized": ["y", "z"]}', "", '{"raw": "a", "normalized": "w"}')
    got = {r.raw: r.normalized for r in rd.scan_lookup_map(spark, path, "color").collect()}
    assert got == {"a": ["w"], "b": ["y", "z"]}


def test_weights_and_ranges(spark, tmp_path):
    path = write(
        tmp_path / "w.jsonl", '{"feature_type": "material", "category": "premium", "weight": 1.4, "items": ["Teak", "oak"]}', '{"feature_type": "material", "category": "low", "weight": 0.5, "items": ["OAK"]}',
        '{"feature_type": "rating_config", "min_rating": 1.0, "rating_thresholds": {"top": [4.5, 5.0, 1.2], "low": [1.0, 4.5, 0.9]}}',
    )
    weights, thresholds = rd.scan_feature_weights(spark, path)
    assert {(r.feature_type, r["item"], r.weight) for r in weights.collect()} == {("material", "teak", 1.4), ("material", "oak", 0.5)}
    assert [tuple(r) for r in thresholds.orderBy("seq").collect()] == [(0, "top", 4.5, 5.0, 1.2), (1, "low", 1.0, 4.5, 0.9)]
    path = write(tmp_path / "r.jsonl", '{"product_class": "K", "price_min": 1, "price_max": 2}', '{"product_class": "K", "price_min": 3, "price_max": 4}')
    assert [tuple(r) for r in rd.scan_price_ranges(spark, path).collect()] == [("K", 3.0, 4.0)]
    path = write(tmp_path / "c.jsonl", '{"product_class": "K", "product_class_fixed": "L"}')
    assert [tuple(r) for r in rd.scan_class_mapping(spark, path).collect()] == [("K", "L")]


def test_embeddings_both_layouts_sorted(spark, tmp_path):
    lines = [
        '{"id": "product_10", "dense_embedding": [1, 2], "sparse_embedding": {"indices": [3], "values": [0.5]}, "metadata": {"product_name": "n"}}',
        '{"id": "product_9", "dense_embedding": [1, 2], "sparse_embedding": {"dimensions": [4], "values": [0.25]}, "metadata": {}}',
        '{"id": "x"', '{"id": "odd", "dense_embedding": [], "sparse_embedding": {"indices": [], "values": []}, "metadata": {}}',
    ]
    good, bad = rd.scan_embeddings(spark, write(tmp_path / "e.jsonl", *lines))
    got = {r.product_id: r for r in good.collect()}
    assert [r.line for r in bad.collect()] == ['{"id": "x"']
    assert got["product_10"].sparse.indices == [3] and got["product_9"].sparse.indices == [4] and len(got) == 3
    stored = spark.createDataFrame([("odd",), ("product_10",), ("product_9",)], "id string")
    wr.write_embeddings(stored, str(tmp_path / "out"))
    names = sorted((tmp_path / "out").glob("part-*"))
    assert [json.loads(x)["id"] for n in names for x in n.read_text().splitlines()] == ["product_9", "product_10", "odd"]


def test_written_results_keep_empty_lists(spark, tmp_path):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    hits = spark.createDataFrame([("a", "p2", 2), ("a", "p1", 1)], "query_id string, product_id string, position int")
    wr.write_result_map(q, hits, str(tmp_path / "r"))
    assert {r.query_id: r.product_ids for r in rd.scan_result_rows(spark, str(tmp_path / "r")).collect()} == {"a": ["p1", "p2"], "b": []}


def test_queries_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("simple-001", "simple", "t", "K", 5.0)], "query_id string, query_type string, query_text string, product_class string, price_max double")
    wr.write_queries(q, str(tmp_path / "q"))
    nested = spark.read.schema(rd.QUERY_SCHEMA).json(str(tmp_path / "q"))
    r = rd.flatten_params(nested).select(*q.columns).first()
    assert tuple(r) == ("simple-001", "simple", "t", "K", 5.0)


def test_products_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("a", 'x "y", z', ["r", "s"], 2.5)], "product_id string, product_name string, color array<string>, price double")
    wr.write_products(p, str(tmp_path / "j"), str(tmp_path / "c"))
    rows, bad = rd.scan_jsonl(spark, str(tmp_path / "j"))
    assert tuple(rows.select(*p.columns).first()) == ("a", 'x "y", z', ["r", "s"], 2.5) and bad.count() == 0
    csv = spark.read.schema("product_id string, product_name string, color string, price double").csv(str(tmp_path / "c"), header=True, escape='"')
    assert tuple(csv.first()) == ("a", 'x "y", z', '["r","s"]', 2.5)
    assert F is not None
