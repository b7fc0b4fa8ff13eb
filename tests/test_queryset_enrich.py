import pytest
from pyspark.sql import functions as F

from shelfrank.operators import enrich as en, queryset as qs, rerank as rr


def test_class_values_are_cleaned(spark):
    df = spark.createDataFrame([("K", ["100 % Cotton ", "cotton", "  "], ["Red"], []), (None, ["x"], [], [])], "product_class string, material array<string>, color array<string>, style array<string>")
    got = {(r.attribute, r.value) for r in qs.class_values(df).collect()}
    assert got == {("material", "cotton"), ("color", "red")}
    text = spark.createDataFrame([("K", "Wood, 20% Steel", ["a"], ["b"])], "product_class string, material string, color array<string>, style array<string>")
    assert {r.value for r in qs.class_values(text).filter("attribute = 'material'").collect()} == {"wood", "steel"}


def test_draw_category_value_skips_unknown(spark):
    df = spark.createDataFrame([(["unknown", "Unknown", "", "oak"],), ([],), (["unknown"],)], "v array<string>")
    assert [r[0] for r in df.select(qs.draw_category_value(F.col("v"), F.lit(0.99))).collect()] == ["oak", "", ""]


def profile(spark):
    return spark.createDataFrame(
        [("Sofas", ["oak"], ["red", "tan"], ["modern"], 3.0, 5.0, 10.0, 900.0, 100.0, 800.0), ("Lamps", [], [], [], None, None, None, None, None, None)],
        "product_class string, materials array<string>, colors array<string>, styles array<string>, rating_lo double, rating_hi double, rating_count_lo double, rating_count_hi double, price_lo double, price_hi double",
    )


def test_generated_queries_keep_their_rules(spark):
    out = qs.gen_queries(profile(spark), {t: 40 for t in qs.QUERY_TYPES}, 2).collect()
    assert len(out) == 4 * 40 * 2
    for r in out:
        params = [r.material, r.color, r.style]
        negated = [r.material_negated, r.color_negated, r.style_negated]
        bounds = [r.rating_min, r.rating_count_min, r.price_max]
        weights = [r.rating_weight, r.rating_count_weight, r.price_weight]
        count = lambda xs: sum(x is not None for x in xs)
        assert r.query_id == f"{r.query_type}-{r.slot:03d}" and "" not in params + negated
        if r.product_class == "Sofas":
            assert count(params) == 1
            assert count(negated) == (r.query_type == "negation")
            assert count(bounds) == (r.query_type == "number")
            assert count(weights) == (r.query_type == "complex")
        if r.query_type == "number":
            assert r.query_text.startswith(r.product_description + ", ")
            if r.product_class == "Lamps":
                assert set(bounds) == {None, 2.0}
        if r.query_type == "negation" and r.product_class == "Sofas":
            said = [v for v in negated if v is not None][0]
            assert f"not {said} " in r.query_text


def test_old_weight_name_is_an_option(spark):
    slots = qs.query_slots(profile(spark), {"complex": 3})
    assert "average_rating_weight" in qs.gen_complex(slots, rating_weight="average_rating_weight").columns


def test_validation_takes_first_good_attempt_and_first_slots(spark):
    attempts = spark.createDataFrame(
        [(f"simple-{s:03d}", "simple", s, a) for s in (1, 2, 3, 4) for a in (1, 2, 3)], "query_id string, query_type string, slot int, attempt int"
    )

    def search(queries):
        # slot 1: only attempt 2 has enough, slot 2: none, slots 3 and 4: all
        n = F.when((F.col("slot") == 1) & (F.col("attempt") == 2), 3).when(F.col("slot") >= 3, 3).otherwise(2)
        return queries.withColumn("position", F.explode(F.sequence(F.lit(1), n))).select("query_id", F.concat(F.lit("p"), "position").alias("product_id"), "position")

    queries, hits = qs.validate_queries(attempts, search, {"simple": 2}, min_results=3)
    assert [(r.query_id, r.attempt) for r in queries.orderBy("slot").collect()] == [("simple-001", 2), ("simple-003", 1)]
    assert hits.count() == 6 and {r.query_id for r in hits.collect()} == {"simple-001", "simple-003"}


def test_renumber(spark):
    q = spark.createDataFrame([("simple-012",), ("simple-2",), ("number-007",), ("simple-100",)], "query_id string")
    r = spark.createDataFrame([("simple-012", "a"), ("simple-100", "b"), ("other-1", "c")], "query_id string, product_id string")
    queries, results = qs.renumber_queries(q, r, 2)
    assert sorted(x[0] for x in queries.collect()) == ["number-001", "simple-001", "simple-002"]
    assert [tuple(x) for x in results.collect()] == [("simple-002", "a")]


def responses(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response_text string")


def test_feature_responses(spark):
    good = '{"USAGE_CONTEXTS": ["office"], "SIZE_DESCRIPTORS": "small"}'
    df = responses(spark, good, f"```json\n{good}\n```", f"```{good}```", f"[{good}]", '{"USAGE', "", None, "  \n")
    got = [(r.USAGE_CONTEXTS, r.SIZE_DESCRIPTORS, r.BENEFIT_PHRASES) for r in en.parse_feature_response(df).orderBy("i").collect()]
    assert got[:3] == [(["office"], [], [])] * 3 and got[3:] == [([], [], [])] * 5


def test_param_responses(spark):
    df = responses(spark, '{"color": "red", "price_max": 10}', '```json\n{"color": ["red", "tan"]}\n```', "[1]", "{bad", "```json\n```", "", None, '"text"')
    got = en.parse_param_response(df).orderBy("i").collect()
    assert (got[0].color, got[0].price_max, got[0].error) == (["red"], 10.0, None) and got[1].color == ["red", "tan"]
    assert [r.error for r in got[2:]] == [en.NOT_A_DICTIONARY, en.INVALID_JSON, en.EMPTY_RESPONSE, None, None, en.NOT_A_DICTIONARY]
    good, bad = en.split_responses(en.parse_param_response(df))
    assert good.count() == 4 and bad.count() == 4


def test_extract_params_of_any_length(spark):
    vocab = spark.createDataFrame([("product_class", "Outdoor Patio Chair Seat Cushions"), ("color", "red"), ("product_class", "Cushions")], "category string, value string")
    q = spark.createDataFrame([("1", "red outdoor patio chair seat cushions")], "query_id string, query_text string")
    r = en.extract_params(q, vocab).first()
    assert r.product_class == "Outdoor Patio Chair Seat Cushions" and r.color == ["red"]
    assert en.extract_params(q, vocab.filter("false")).first().product_class is None


def test_extract_params(spark):
    vocab = spark.createDataFrame(
        [("color", "white"), ("material", "wool"), ("material", "solid wood"), ("style", "rustic"), ("product_class", "Ottomans"), ("product_class", "Storage Ottomans")],
        "category string, value string",
    )
    q = spark.createDataFrame(
        [("a", "white not rustic style wool storage ottomans for living rooms, with more than 1000 ratings"), ("b", "Solid Wood thing, under $250"),
         ("c", "ottomans, with more than 3.5 stars rating"), ("d", "")], "query_id string, query_text string")
    got = {r.query_id: r for r in en.extract_params(q, vocab).collect()}
    a = got["a"]
    assert (a.color, a.material, a.style, a.style_negated, a.product_class, a.rating_count_min) == (["white"], ["wool"], None, ["rustic"], "Storage Ottomans", 1000.0)
    assert a.product_description == "white not rustic style wool storage ottomans for living rooms"
    assert got["b"].material == ["solid wood"] and got["b"].price_max == 250.0 and got["b"].product_description == "Solid Wood thing"
    assert got["c"].rating_min == 3.5 and got["c"].product_class == "Ottomans"
    assert got["d"].color is None and got["d"].product_description == ""


def test_enrich_and_accept(spark):
    empty = {t: F.array().cast("array<string>") for t in en.FEATURE_TYPES}
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "product_class string").withColumns(empty)
    features = classes.withColumn("USAGE_CONTEXTS", F.when(F.col("product_class") == "A", F.array(F.lit("office"))).otherwise(F.col("USAGE_CONTEXTS"))).withColumn(
        "SIZE_DESCRIPTORS", F.when(F.col("product_class") == "B", F.array(F.lit("small"))).otherwise(F.col("SIZE_DESCRIPTORS"))
    )
    q = spark.createDataFrame(
        [("1", "simple", "red sofa", "red sofa", "A"), ("2", "simple", "lamp", "lamp", "B"), ("3", "simple", "rug", "rug", "C"), ("4", "simple", "x", "x", "Z"), ("5", "synth", "y", "y", "A")],
        "query_id string, query_type string, query_text string, product_description string, product_class string",
    )
    enriched = en.enrich_queries(q, features)
    assert {r.query_id: (r.query_text, r.product_description) for r in enriched.collect()} == {
        "1": ("red sofa, for office",) * 2, "2": ("small lamp",) * 2, "3": ("rug", "rug")
    }
    hits = spark.createDataFrame([("1", f"p{i}") for i in range(15)] + [("2", "p0")], "query_id string, product_id string")
    queries, kept = en.accept_enriched(q, enriched, hits)
    assert {r.query_id: (r.query_text, r.product_description, r.accepted) for r in queries.collect()} == {
        "1": ("red sofa, for office", "red sofa, for office", True), "2": ("lamp", "lamp", False), "3": ("rug", "rug", False)
    }
    assert kept.count() == 15


def test_mined_terms(spark):
    texts = spark.createDataFrame([("A", "easy clean sofa red"), ("A", "sofa easy clean"), ("A", "rare sofa"), ("B", "sofa lamp"), ("B", "lamp sofa")], "product_class string, text string")
    vocab = spark.createDataFrame([("Red",)], "value string")
    got = {}
    for r in en.mine_class_terms(texts, vocab).orderBy("product_class", "position").collect():
        got.setdefault(r.product_class, []).append((r.term, r.df))
    assert got["A"][:3] == [("clean", 2), ("easy", 2), ("easy clean", 2)] and got["B"][0] == ("lamp", 2)


def products(spark):
    return spark.createDataFrame(
        [("a", "Red Sofa", "Sofas", "soft", ["red"], ["oak"], [], ["Italy"], 10.0, 4.5, 7), ("b", "Blue Lamp", "Lamps", None, [], [], [], [], None, None, None)],
        "product_id string, product_name string, product_class string, product_description string, color array<string>, material array<string>, style array<string>, countryoforigin array<string>, price double, average_rating double, rating_count bigint",
    )


def test_rerank_content_layouts(spark):
    c = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "gone", 3)], "query_id string, product_id string, rank int")
    pipes = {r.product_id: r.content for r in rr.rerank_content(c, products(spark)).collect()}
    assert pipes["a"] == "soft | Category: Sofas | Price: $10.0 | Rating: 4.5 | Rating Count: 7 | Colors: red | Materials: oak | Styles:  | Country: Italy"
    lines = {r.product_id: r.content for r in rr.rerank_content(c, products(spark), "lines").collect()}
    assert lines["b"] == "\nCategory: Lamps\nPrice: $N/A\nRating: N/A (N/A reviews)\nColors: \nMaterials: \nStyles: \nCountry: "
    assert set(pipes) == {"a", "b"}


def test_rerank_batch(spark):
    q = spark.createDataFrame([("1", "blue lamp"), ("2", ""), ("3", "x"), ("4", "y")], "query_id string, query_text string")
    results = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b"]), ("3", []), ("9", ["a"])], "query_id string, product_ids array<string>")
    got = {r.query_id: r.product_ids for r in rr.rerank_batch(q, results, products(spark)).collect()}
    assert got == {"1": ["b", "a"], "2": ["a", "b"], "3": []}


@pytest.mark.parametrize("stat, lo, hi", [("rating", 3.0, 5.0), ("rating_count", 0.0, 1000.0), ("price", 100.0, 900.0)])
def test_drawn_stats_stay_inside(spark, stat, lo, hi):
    from shelfrank.functions.draws import uniform

    df = spark.range(2000).select(qs.draw_stat(F.lit(stat), F.lit(lo), F.lit(hi), uniform(1, "s", "id")).alias("v"))
    r = df.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert lo <= r[0] and r[1] <= hi
    # Beta(1,3) has mean 1/4, Beta(3,1) mean 3/4
    assert (r[2] - lo) / (hi - lo) == pytest.approx(0.75 if stat == "price" else 0.25, abs=0.03)


def test_synthetic_queries_follow_with_their_lists(spark):
    from shelfrank.plans import benchmark as bm

    queries = spark.createDataFrame([("simple-001", "simple", "a", "K")], "query_id string, query_type string, query_text string, product_class string")
    truth = spark.createDataFrame([("simple-001", ["p1"])], "query_id string, product_ids array<string>")
    synthetic = spark.createDataFrame([("synth-001", "synth", "b"), ("synth-002", "synth", "c")], "query_id string, query_type string, query_text string")
    lists = spark.createDataFrame([("synth-001", ["p2", "p3"])], "query_id string, product_ids array<string>")
    all_queries, all_truth = bm.add_synthetic(queries, truth, synthetic, lists)
    assert [(r.query_id, r.product_class) for r in all_queries.orderBy("query_id").collect()] == [("simple-001", "K"), ("synth-001", None)]
    assert {r.query_id: r.product_ids for r in all_truth.collect()} == {"simple-001": ["p1"], "synth-001": ["p2", "p3"]}


def test_features_from_responses_keep_their_types(spark):
    from shelfrank.plans import benchmark as bm

    answers = spark.createDataFrame([("Chairs", '{"USAGE_CONTEXTS": ["office"]}')], "product_class string, response_text string")
    q = spark.createDataFrame([("simple-001", "simple", "red chair", "Chairs", "red chair")], "query_id string, query_type string, query_text string, product_class string, product_description string")
    assert en.enrich_queries(q, bm.response_features(answers)).first().query_text == "red chair, for office"
