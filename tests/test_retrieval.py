import math
import random

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import boosting, filters, retrieval as rt, textsearch as ts, vectors as vec

PRODUCTS = "product_id string, product_name string, product_class string, product_description string, color array<string>, material array<string>, style array<string>, price double, average_rating double, rating_count bigint, vector array<float>"
QUERIES = "query_id string, query_text string, product_class string, color array<string>, material array<string>, style array<string>, color_negated array<string>, material_negated array<string>, style_negated array<string>, price_max double, rating_min double, rating_count_min double, vector array<float>"
COLORS, MATERIALS, STYLES = ["red", "blue", "white"], ["wood", "steel"], ["modern", "rustic"]


def some(rnd, values, p=0.5):
    return [v for v in values if rnd.random() < p]


def data(spark, seed=3, n_products=120, n_queries=30):
    rnd = random.Random(seed)
    vector = lambda: [round(rnd.uniform(-1, 1), 3) for _ in range(4)] if rnd.random() > 0.2 else [0.0] * 4
    maybe = lambda v, p: v if rnd.random() < p else None
    products = [
        (f"p{i:03d}", f"{rnd.choice(COLORS)} {rnd.choice(['chair', 'table', 'lamp'])}", rnd.choice(["Chairs", "Tables"]), "a thing of wood",
         maybe(some(rnd, COLORS), 0.9), some(rnd, MATERIALS), some(rnd, STYLES), maybe(float(rnd.randrange(10, 500)), 0.9), maybe(rnd.randrange(10, 50) / 10, 0.9), maybe(rnd.randrange(0, 500), 0.9), vector())
        for i in range(n_products)
    ]
    queries = [
        (f"q{i:02d}", f"{rnd.choice(COLORS)} {rnd.choice(['chair', 'lamp'])} wood", maybe(rnd.choice(["Chairs", "tables", ""]), 0.7),
         maybe(some(rnd, COLORS + [" "]) * 2, 0.4), maybe(some(rnd, MATERIALS), 0.3), maybe(some(rnd, STYLES), 0.2),
         maybe(some(rnd, COLORS, 0.3), 0.3), maybe(some(rnd, MATERIALS, 0.3), 0.2), None,
         maybe(rnd.choice([0.0, 100.0, 300.0]), 0.4), maybe(rnd.choice([-1.0, 0.0, 3.0]), 0.4), maybe(rnd.choice([0.0, 200.0]), 0.3), vector())
        for i in range(n_queries)
    ]
    return products, queries, spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(queries, QUERIES)


def holds(p, q, absent="positive"):
    """Plain restatement of the conditions on one product row and one query row."""
    for held, wanted, unwanted in ((p[4], q[3], q[6]), (p[5], q[4], q[7]), (p[6], q[5], q[8])):
        held = held or []
        wanted, unwanted = [w for w in wanted or [] if w.strip()], [w for w in unwanted or [] if w.strip()]
        if wanted and not set(held) & set(wanted) or set(held) & set(unwanted):
            return False
    given = {"positive": lambda b: b is not None and b > 0, "truthy": lambda b: bool(b), "null_only": lambda b: b is not None}[absent]
    if given(q[9]) and not (p[7] is not None and p[7] <= q[9]):
        return False
    if given(q[10]) and not (p[8] is not None and p[8] >= q[10]):
        return False
    return not (given(q[11]) and not (p[9] is not None and p[9] >= q[11]))


@pytest.mark.parametrize("absent", filters.ABSENT_RULES)
def test_filter_matches_every_pair(spark, absent):
    products, queries, p, q = data(spark)
    got = [tuple(r) for r in filters.param_filter(p, q, absent).collect()]
    want = {(b[0], a[0]) for a in products for b in queries if holds(a, b, absent)}
    assert len(got) == len(set(got)) and set(got) == want


def test_more_conditions_never_match_more(spark):
    _, _, p, q = data(spark)
    loose = {tuple(r) for r in filters.param_filter(p, q.withColumn("price_max", F.lit(None).cast("double"))).collect()}
    assert {tuple(r) for r in filters.param_filter(p, q).collect()} <= loose


def test_class_text_only_narrows_other_conditions(spark):
    products, queries, p, q = data(spark)
    got = {tuple(r) for r in filters.param_filter(p, q, class_text=True).collect()}
    for b in queries:
        free = all(holds(a, b) for a in products)
        for a in products:
            named = not b[2] or b[2].lower() in a[2].lower()
            if holds(a, b) and not free:
                assert ((b[0], a[0]) in got) == named or not _has_condition(b)


def _has_condition(q):
    lists = [[w for w in v or [] if w.strip()] for v in q[3:9]]
    return any(lists) or any(b is not None and b > 0 for b in q[9:12])


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


@pytest.mark.parametrize("options", [{}, {"max_inline": 7, "docs_per_chunk": 25}])
def test_dense_topk_is_exact_under_conditions(spark, options):
    products, queries, p, q = data(spark)
    got = {}
    for r in vec.dense_topk(p.repartition(5), q, 10, True, **options).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.product_id, r.score))
    for b in queries:
        scores = sorted(((-round(cosine([float(F32(x)) for x in a[10]], [float(F32(x)) for x in b[12]]), 9), a[0]) for a in products if holds(a, b)))[:10]
        mine = got.get(b[0], [])
        assert [d for d, _ in mine] == [d for _, d in scores]
        assert [s for _, s in mine] == pytest.approx([-s for s, _ in scores], abs=1e-8)


@pytest.mark.parametrize("most_bytes", [64 << 20, 8 * 4 * 10])
def test_documents_may_ask_for_each_other(spark, monkeypatch, most_bytes):
    """Queries made from the documents themselves, within one shipped table and in blocks that the bytes make small."""
    _, _, p, _ = data(spark)
    monkeypatch.setattr(vec, "MAX_CHUNK_BYTES", most_bytes)
    docs = p.select("product_id", "vector")
    asked = p.select("product_id", "price").join(docs, "product_id").withColumnRenamed("product_id", "query_id")
    got = {(r.query_id, r.product_id): r.score for r in vec.dense_topk(docs, asked, 120).collect()}
    rows = docs.collect()
    want = {(a.product_id, b.product_id): cosine(a.vector, b.vector) for a in rows for b in rows}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


@pytest.mark.parametrize("max_inline", [1024, 4])
def test_weighted_search_sums_its_parts(spark, monkeypatch, max_inline):
    products, queries, p, q = data(spark, n_products=60, n_queries=12)
    q = q.withColumn("price_weight", F.lit(-0.5)).withColumn("class_space_weight", F.lit(0.25))
    run = vec.vector_topk
    monkeypatch.setattr(rt, "vector_topk", lambda *a: run(*a, max_inline=max_inline, docs_per_chunk=20))
    got = {}
    for r in rt.multi_attribute_search(p, q, 5).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.product_id, r.score))
    for b in queries:
        scored = []
        for a in products:
            if holds(a, b):
                price = math.log1p(a[7]) / math.log1p(5900) if a[7] is not None else 0.0
                same = bool(b[2]) and b[2].lower() == a[2].lower()
                scored.append((-round(cosine([F32(x) for x in a[10]], [F32(x) for x in b[12]]) - 0.5 * price + 0.25 * same, 9), a[0]))
        want = sorted(scored)[:5]
        assert [d for d, _ in got.get(b[0], [])] == [d for _, d in want]


def F32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_ties_at_the_cut_go_by_id(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", [0.0, 0.0]) for i in range(500)], "product_id string, vector array<float>").repartition(6)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [r.product_id for r in vec.dense_topk(docs, asked, 5).orderBy("position").collect()] == [f"d{i:03d}" for i in range(5)]


def bm25(texts, query):
    words = {k: t.lower().split() for k, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for k, w in words.items():
        s = 0.0
        for t in query.lower().split():
            tf, df = w.count(t), sum(t in x for x in words.values())
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s:
            out[k] = s
    return out


def test_sparse_topk_matches_brute_force(spark):
    rnd = random.Random(5)
    # one word is in nearly every text
    texts = {f"d{i:03d}": " ".join(["the"] * rnd.randrange(0, 4) + rnd.choices(["oak", "pine", "elm", "ash"], k=rnd.randrange(0, 8))) for i in range(200)}
    queries = {"q1": "the oak", "q2": "the the elm ash", "q3": "missing", "q4": ""}
    t = spark.createDataFrame(list(texts.items()), "product_id string, text string").repartition(7)
    q = spark.createDataFrame(list(queries.items()), "query_id string, query_text string")
    got = {}
    for r in ts.sparse_topk(t, q, 25).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.product_id, r.score))
    for k, text in queries.items():
        want = sorted(bm25(texts, text).items(), key=lambda x: (-round(x[1], 9), x[0]))[:25]
        assert [d for d, _ in got.get(k, [])] == [d for d, _ in want]
        assert [s for _, s in got.get(k, [])] == pytest.approx([s for _, s in want], abs=1e-8)


def test_search_in_blocks_agrees(spark):
    _, _, p, q = data(spark)
    fields = p.select("product_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(b).alias("boost"), F.col(f).alias("text")) for f, b in (("product_name", 3.0), ("product_description", 2.0))])).alias("f")).select("product_id", "f.*")
    a = sorted(map(str, ts.search_texts(fields, q, 10, products=p).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted(map(str, ts.search_texts(fields, q, 10, products=p, max_terms=25).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a == b and a


def test_queries_with_the_same_known_words_are_searched_once(spark, monkeypatch):
    texts = spark.createDataFrame([(f"d{i:02d}", f"Brand#{i % 4} {i % 7}") for i in range(60)] + [("blank", None)], "product_id string, text string")
    lines = [(f"q{i:03d}", f"{i % 4} {i % 7} line{i}") for i in range(300)] + [(None, "3 5"), (None, "3"), ("twice", "2 2"), ("unknown", "zzz"), ("empty", None)]
    asked = spark.createDataFrame(lines, "query_id string, query_text string")
    want = sorted(map(str, ts.sparse_topk(texts, asked, 5).collect()))
    sets = []
    monkeypatch.setattr(ts, "word_sets", lambda *given, made=ts.word_sets: sets.append(made(*given)) or sets[-1])
    assert sorted(map(str, ts.search_texts(ts.one_field(texts), asked, 5, max_terms=20).collect())) == want and want
    # 22 pairs of words in any order, and the three words of the null query; "2 2" is one of the pairs.
    assert sets[0][0].select("query_id").distinct().count() == 23 and sets[0][1].count() == 302


def test_sparse_dot(spark):
    docs = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 5.0), ("c", 9, 1.0)], "product_id string, term int, weight double")
    asked = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.5)], "query_id string, term int, weight double")
    got = [(r.product_id, r.score) for r in ts.sparse_dot_topk(docs, asked, 2).orderBy("position").collect()]
    assert got == [("a", 2.5), ("b", 2.5)]


def test_fusion_rules(spark):
    lists = [("q", "dense", "a", 3.0), ("q", "dense", "b", 2.0), ("q", "dense", "c", 1.0), ("q", "sparse", "c", 7.0), ("r", "dense", "a", 1.0), ("r", "dense", "b", 1.0)]
    df = spark.createDataFrame(lists, "query_id string, source string, product_id string, score double")
    got = {(r.query_id, r.product_id): r.score for r in rt.dbsf_fusion(df, 10).collect()}
    assert got[("q", "a")] == pytest.approx((3 - (2 - 3)) / 6) and got[("q", "b")] == pytest.approx(0.5)
    assert got[("q", "c")] == pytest.approx((1 + 1) / 6 + 0.5)
    assert got[("r", "a")] == got[("r", "b")] == 0.5


def test_numeric_score(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (5900.0,), (9999.0,), (None,)], "v double")
    got = [r[0] for r in df.select(rt.numeric_score(F.col("v"), 5900, True)).collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, None]
    assert spark.range(1).select(rt.numeric_score(F.lit(2.5), 5, False)).first()[0] == 0.5


def test_boost_rules_signs_and_limit(spark):
    stats = spark.createDataFrame(
        [(n, l, v) for n in ("price", "average_rating", "rating_count") for l, v in (("p25", 1.9), ("p50", 2.0), ("p75", 3.0), ("p90", 4.7))],
        "name string, label string, value double",
    )
    q = spark.createDataFrame([("cheap", -2.0, None, None), ("dear", 1.0, 0.0, None), ("good", None, 1.0, 1.0), ("bad", None, -1.0, -1.0)],
                              "query_id string, price_weight double, rating_weight double, rating_count_weight double")
    got = {}
    for r in boosting.boost_rules(q, stats).collect():
        got.setdefault(r.query_id, set()).add((r.field, r.op, r.bound, round(r.boost, 6)))
    assert got["cheap"] == {("price", "<=", 1.9, 0.9), ("price", "<=", 2.0, 0.6)}
    assert got["dear"] == {("price", ">=", 3.0, 0.3), ("price", ">=", 4.7, 0.5)}
    assert got["good"] == {("average_rating", ">=", 4.7, 0.5), ("average_rating", ">=", 3.0, 0.3), ("rating_count", ">=", 4.0, 0.4), ("rating_count", ">=", 3.0, 0.2)}
    assert got["bad"] == {("average_rating", "<=", 1.9, -0.3), ("rating_count", "<=", 1.0, -0.3)}


def test_boost_apply_reranks(spark):
    products = spark.createDataFrame([("a", 10.0, 1.0, 1), ("b", 100.0, 1.0, 1), ("c", None, 1.0, 1)], "product_id string, price double, average_rating double, rating_count bigint")
    hits = spark.createDataFrame([("q", "b", 2.0), ("q", "a", 1.5), ("q", "c", 1.9), ("z", "a", 1.0)], "query_id string, product_id string, score double")
    rules = spark.createDataFrame([("q", "price", "<=", 20.0, 0.6), ("q", "price", "<=", 50.0, 0.3)], "query_id string, field string, op string, bound double, boost double")
    got = [(r.query_id, r.product_id, r.boosted) for r in boosting.boost_apply(hits, rules, products).orderBy("query_id", "position").collect()]
    assert got == [("q", "a", 2.85), ("q", "b", 2.0), ("q", "c", 1.9), ("z", "a", 1.0)]


def test_query_modes_and_lists(spark):
    q = spark.createDataFrame([("a", "t", "K", 5.0), ("b", "u", None, None)], "query_id string, query_text string, product_class string, price_max double")
    assert [tuple(r) for r in rt.query_mode(q, "none").select("product_class", "price_max").collect()] == [(None, None)] * 2
    extracted = spark.createDataFrame([("b", "X")], "query_id string, product_class string")
    got = {r.query_id: (r.product_class, r.price_max) for r in rt.query_mode(q, "nlq", extracted).collect()}
    assert got == {"a": (None, None), "b": ("X", None)}
    with pytest.raises(ValueError):
        rt.query_mode(q, "other")
    hits = spark.createDataFrame([("a", "p2", 2), ("a", "p1", 1), ("a", None, 3)], "query_id string, product_id string, position int")
    assert {r.query_id: r.product_ids for r in rt.result_lists(q, hits).collect()} == {"a": ["p1", "p2"], "b": []}
    params = rt.restrict_params(rt.params_map(q), ["price_max", "natural_query"])
    assert {r.query_id: r.params for r in params.collect()} == {"a": {"price_max": "5.0"}, "b": {}}


def test_query_text_expand(spark):
    q = spark.createDataFrame([("t", "Sofa"), ("t", None), ("", "Sofa"), ("t", "")], "query_text string, product_class string")
    assert [r.search_text for r in ts.query_text_expand(q).collect()] == ["t | product_class: SOFA", "t", "product_class: SOFA", "t"]


def test_sparse_form_of_dense(spark):
    df = spark.createDataFrame([([0.0, 1.5, 0.0, -2.0],)], "v array<float>")
    s = df.select(vec.dense_nonzero_to_sparse(F.col("v")).alias("s")).first().s
    assert s.indices == [1, 3] and s["values"] == [1.5, -2.0]


@pytest.mark.parametrize("limit", [200_000, 1])
def test_one_word_in_every_text(spark, monkeypatch, limit):
    """A word of all documents: the same weights whether the vocabulary is sent or joined."""
    small = ts.small_side
    monkeypatch.setattr(ts, "small_side", lambda df: small(df, limit))
    texts = spark.range(3000).select(F.col("id").alias("product_id"), F.concat(F.lit("the w"), F.col("id") % 7).alias("text"))
    made = ts.sparse_vectors(texts)
    rows = made.groupBy("term").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()
    assert {r.term: r.n for r in rows} == {"the": 3000} | {f"w{i}": 429 if i < 4 else 428 for i in range(7)}
    assert min(rows, key=lambda r: r.w).term == "the"
    if limit > 1:
        assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()


def test_many_queries_move_few_rows(spark, monkeypatch):
    """Unfiltered blocks are as large as memory allows: a document is not sent once per thousand queries."""
    docs = spark.range(300).select(F.col("id").alias("product_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7)).alias("vector"))
    asked = spark.range(2500).select(F.col("id").alias("query_id"), F.array(F.sin(F.col("id") * 3), F.cos(F.col("id") * 5), F.lit(0.5)).alias("vector"))
    sent, run = [], vec.dealt
    monkeypatch.setattr(vec, "dealt", lambda left, right, key, groups: (sent.append((left.count(), right.count(), groups)), run(left, right, key, groups))[1])
    got = sorted((r.query_id, r.position, r.product_id, r.score) for r in vec.dense_topk(docs, asked, 4).collect())
    assert sent == [(300, 2500, 1)]
    monkeypatch.setattr(vec, "TILE_SCORES", 1000)
    assert got == sorted((r.query_id, r.position, r.product_id, r.score) for r in vec.dense_topk(docs, asked, 4, max_inline=5000).collect()) and len(got) == 10000


def test_sparse_vectors_cut_texts_once(spark):
    """Words are counted inside their row: unique keys need no exchange of words; rows of one key and length are summed."""
    texts = [(1, "b a b"), (2, ""), (3, None), (4, "A c"), (5, "b")]
    unique = ts.sparse_vectors(spark.createDataFrame(texts, "product_id long, text string"))
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "hashpartitioning(product_id" not in plan
    assert {(r.product_id, r.term): r.tf for r in unique.collect()} == {(1, "a"): 1, (1, "b"): 2, (4, "a"): 1, (4, "c"): 1, (5, "b"): 1}
    twice = ts.sparse_vectors(spark.createDataFrame(texts + [(1, "b c d"), (4, "x")], "product_id long, text string"))
    got = sorted((r.product_id, r.term, r.tf) for r in twice.collect())
    assert got == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (1, "d", 1), (4, "a", 1), (4, "c", 1), (4, "x", 1), (5, "b", 1)]
