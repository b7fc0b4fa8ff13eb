"""Retrieval over the whole derived catalogue, all documents and all vectors."""

from pyspark.sql import functions as F

from checks.catalog_checks import JOIN_COLUMNS, STRINGIFY
from checks.fixtures import duck, table, view
from checks.registry import check, rounded
from shelfrank.operators import bitmaps, blockmax, boosting, catalog as cat, cells, filters, retrieval as rt, textsearch as ts, vectors as vec
from shelfrank.operators.profiling import value_counts

DIM = 64
CQ = duck("c", "q")
TOKENS = lambda e: f"list_filter(string_split_regex(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def products(spark, sf):
    return view(spark, sf, "c")


def queries(spark, sf):
    return view(spark, sf, "q")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("product_"), F.col("vec_id")).alias("product_id"), F.col("embedding").alias("vector"))


def vector_products(spark, sf):
    return vec.dense_vectors(products(spark, sf), vectors(spark, sf), DIM)


def vector_queries(spark, sf):
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return vec.dense_vectors(queries(spark, sf), own, DIM, "idx")


# ---------------------------------------------------------------- filters


def absent_sql(mode, p):
    return {"positive": f"(q.{p} IS NULL OR q.{p} <= 0)", "truthy": f"(q.{p} IS NULL OR q.{p} = 0)", "null_only": f"q.{p} IS NULL"}[mode]


def condition(mode="positive", class_text=False):
    parts, some = [], []
    for a in ("color", "material", "style"):
        parts.append(f"(q.{a} IS NULL OR len(q.{a}) = 0 OR coalesce(list_has_any(c.{a}, q.{a}), false))")
        parts.append(f"(q.{a}_negated IS NULL OR len(q.{a}_negated) = 0 OR NOT coalesce(list_has_any(c.{a}, q.{a}_negated), false))")
        some += [f"coalesce(len(q.{a}), 0) > 0", f"coalesce(len(q.{a}_negated), 0) > 0"]
    for col, p, op in (("price", "price_max", "<="), ("average_rating", "rating_min", ">="), ("rating_count", "rating_count_min", ">=")):
        parts.append(f"({absent_sql(mode, p)} OR coalesce(c.{col} {op} q.{p}, false))")
        some.append(f"NOT {absent_sql(mode, p)}")
    if class_text:
        parts.append(f"(q.product_class IS NULL OR NOT ({' OR '.join(some)}) OR contains(lower(c.product_class), lower(q.product_class)))")
    return " AND ".join(parts)


def matched(mode="positive", class_text=False):
    return f"WITH {CQ} SELECT query_id, count(*) AS n, cast(sum(p_partkey) AS bigint) AS keys FROM q JOIN c ON {condition(mode, class_text)} GROUP BY ALL"


def run_filter(spark, sf, **options):
    p = products(spark, sf)
    pairs = filters.param_filter(p, queries(spark, sf), **options)
    key = F.regexp_extract("product_id", r"(\d+)", 1).cast("long")
    return pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


def run_bitmaps(spark, sf, **options):
    pairs = bitmaps.bitmap_filter(products(spark, sf), queries(spark, sf), **options)
    key = F.regexp_extract("product_id", r"(\d+)", 1).cast("long")
    return pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


check("param_filter", matched())(lambda spark, sf: run_filter(spark, sf))
check("param_filter_bitmaps", matched())(lambda spark, sf: run_bitmaps(spark, sf))
check("class_text_filter_bitmaps", matched(class_text=True))(lambda spark, sf: run_bitmaps(spark, sf, class_text=True))
check("class_text_filter", matched(class_text=True))(lambda spark, sf: run_filter(spark, sf, class_text=True))


@check("param_filter_mode", " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({matched(m)}) m_{m}" for m in filters.ABSENT_RULES))
def _(spark, sf):
    parts = [run_filter(spark, sf, absent=m).withColumn("mode", F.lit(m)) for m in filters.ABSENT_RULES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- texts and sparse vectors


@check("product_text", f"""WITH {duck('p')} SELECT product_id, 'product_class: ' || upper(coalesce(product_class, '')) || ' | product_name: ' || product_name
 || ' | product_description: ' || coalesce(product_description, '') AS text FROM p""")
def _(spark, sf):
    return ts.product_text(view(spark, sf, "p")).select("product_id", "text")


@check("query_text_expand", f"WITH {duck('q')} SELECT query_id, query_text || coalesce(' | product_class: ' || upper(product_class), '') AS search_text FROM q")
def _(spark, sf):
    return ts.query_text_expand(queries(spark, sf)).select("query_id", "search_text")


def bm25(texts, asks, where="true", extra=""):
    """SQL for the scores: ``texts`` has id, field, boost, text; ``asks`` has query_id, text."""
    return f"""texts AS MATERIALIZED ({texts}), asks AS ({asks}),
words AS MATERIALIZED (SELECT id, field, boost, {TOKENS('text')} AS w FROM texts),
lens AS (SELECT field, count(*) AS docs, avg(len(w)) AS ml FROM words GROUP BY ALL),
tf AS MATERIALIZED (SELECT id, field, boost, l, term, count(*) AS tf FROM (SELECT id, field, boost, len(w) AS l, unnest(w) AS term FROM words) x GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS('text')}) AS term FROM asks) x GROUP BY ALL),
weights AS (SELECT id, field, boost, term, tf, ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * l / ml)) AS w
  FROM tf JOIN df USING (field, term) JOIN lens USING (field)),
scores AS (SELECT query_id, id, {rounded('sum(boost * qtf * w)', 9)} AS score FROM weights JOIN qt USING (term) {extra} WHERE {where} GROUP BY ALL),
ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS position FROM scores)"""


DOC_TEXTS = "SELECT cast(doc_id AS varchar) AS id, 'text' AS field, 1.0::double AS boost, text FROM documents"
BENCH = "SELECT 'b-' || item_id AS query_id, text FROM benchmark"


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("product_id"), "text")


def benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat(F.lit("b-"), F.col("item_id")).alias("query_id"), F.col("text").alias("query_text"))


@check("sparse_vectors", f"WITH {bm25(DOC_TEXTS, BENCH)} SELECT id AS product_id, term, tf, {rounded('w', 6)} AS weight FROM weights")
def _(spark, sf):
    return ts.sparse_vectors(documents(spark, sf)).withColumn("weight", F.round("weight", 6))


@check("sparse_topk", f"WITH {bm25(DOC_TEXTS, BENCH)} SELECT query_id, id AS product_id, {rounded('score', 6)} AS score, position FROM ranked WHERE position <= 20")
def _(spark, sf):
    return ts.sparse_topk(documents(spark, sf), benchmark(spark, sf), 20).withColumn("score", F.round("score", 6))


@check("sparse_topk_bounded", f"WITH {bm25(DOC_TEXTS, BENCH)} SELECT query_id, id AS product_id, {rounded('score', 6)} AS score, position FROM ranked WHERE position <= 20")
def _(spark, sf):
    return blockmax.bounded_topk(documents(spark, sf), benchmark(spark, sf), 20).withColumn("score", F.round("score", 6))


FIELDS = "SELECT product_id AS id, f AS field, b AS boost, t AS text FROM (" + " UNION ALL ".join(
    f"SELECT product_id, '{f}' AS f, {b}::double AS b, {'coalesce(array_to_string(' + f + ', chr(32)), chr(32))' if f in ('material', 'style', 'color') else f} AS t FROM c"
    for f, b in ts.FIELD_BOOSTS.items()
) + ") x"
JOIN_CQ = "JOIN q USING (query_id) JOIN c ON c.product_id = id"


@check("fielded_search", f"WITH {CQ}, {bm25(FIELDS, 'SELECT query_id, query_text AS text FROM q', condition(), JOIN_CQ)} SELECT query_id, id AS product_id, {rounded('score', 6)} AS score, position FROM ranked WHERE position <= 10")
def _(spark, sf):
    return ts.fielded_search(products(spark, sf), queries(spark, sf)).withColumn("score", F.round("score", 6))


@check("baseline_search", f"WITH {CQ}, {bm25(f'SELECT product_id AS id, chr(116) AS field, 1.0::double AS boost, {STRINGIFY} AS text FROM c', 'SELECT query_id, query_text AS text FROM q')} SELECT query_id, id AS product_id, {rounded('score', 6)} AS score, position FROM ranked WHERE position <= 10")
def _(spark, sf):
    return ts.baseline_search(products(spark, sf), queries(spark, sf), JOIN_COLUMNS).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- dense vectors


@check("dense_vectors", f"""WITH {duck('c')} SELECT product_id, len(v) AS size, {rounded('list_sum(list_transform(v, lambda x: abs(x::double)))', 6)} AS magnitude FROM
 (SELECT product_id, coalesce(embedding, [0.0::float for i in range({DIM})]) AS v FROM c LEFT JOIN embeddings e ON e.vec_id = c.p_partkey) x""")
def _(spark, sf):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return vector_products(spark, sf).select("product_id", F.size("vector").cast("long").alias("size"), F.round(total, 6).alias("magnitude"))


@check("dense_nonzero_to_sparse", """SELECT vec_id AS product_id, i - 1 AS term, x::double AS weight FROM
 (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) e, LATERAL (SELECT CASE WHEN abs(v) < 0.1 THEN 0 ELSE v END AS x) l WHERE x <> 0""")
def _(spark, sf):
    # Small entries are set to zero first so that there is something to leave out.
    clipped = F.transform("embedding", lambda x: F.when(F.abs(x) < F.lit(0.1), F.lit(0.0).cast("float")).otherwise(x))
    sparse = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), vec.dense_nonzero_to_sparse(clipped).alias("sparse"))
    return ts.explode_sparse(sparse, "product_id").withColumn("term", F.col("term").cast("long"))


CENTROIDS = """flat AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT 'label-' || label AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM flat GROUP BY ALL) g GROUP BY label)"""


def centroids(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c.x)
    return means.groupBy("label").agg(ordered.alias("vector")).select(F.concat(F.lit("label-"), F.col("label")).alias("query_id"), "vector")


@check("dense_topk", f"""WITH {CENTROIDS}, s AS (SELECT query_id, vec_id AS product_id, {rounded('list_cosine_similarity(v, embedding::double[])', 9)} AS score FROM cent, embeddings),
 r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS int) AS position FROM s) SELECT query_id, product_id, {rounded('score', 6)} AS score, position FROM r WHERE position <= 20""")
def _(spark, sf):
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))
    return vec.dense_topk(docs, centroids(spark, sf), 20).withColumn("score", F.round("score", 6))


DENSE_MANY = f"""WITH a AS (SELECT p_partkey AS query_id, embedding::double[] AS v FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
 s AS (SELECT query_id, vec_id AS product_id, {rounded('list_cosine_similarity(v, embedding::double[])', 9)} AS score FROM a, embeddings),
 r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS int) AS position FROM s) SELECT query_id, product_id, {rounded('score', 6)} AS score, position FROM r WHERE position <= 5"""


def parts_as_queries(spark, sf):
    """A query set too large to travel with the job: every part asks with a stored vector."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % docs.count()).alias("product_id")).join(docs, "product_id").drop("product_id")
    return docs, asked


@check("dense_topk_many", DENSE_MANY)
def _(spark, sf):
    return vec.dense_topk(*parts_as_queries(spark, sf), 5).withColumn("score", F.round("score", 6))


@check("dense_topk_cells", DENSE_MANY)
def _(spark, sf):
    docs, asked = parts_as_queries(spark, sf)
    return cells.cell_topk(cells.cell_index(docs, 64), asked, 5).drop("certified").withColumn("score", F.round("score", 6))




PART_TEXTS = "SELECT cast(p_partkey AS varchar) AS id, 'text' AS field, 1.0::double AS boost, p_brand || ' ' || p_size AS text FROM part"
LINE_TEXTS = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS query_id, concat_ws(' ', split_part(p_brand, '#', 2), p_size, l_returnflag, l_linestatus, 'line' || l_linenumber) AS text
 FROM lineitem JOIN part ON p_partkey = l_partkey"""


MANY = f"WITH {bm25(PART_TEXTS, LINE_TEXTS)} SELECT query_id, id AS product_id, {rounded('score', 6)} AS score, position FROM ranked WHERE position <= 5"


def parts_and_lines(spark, sf):
    """A query set of more words than one broadcast holds: every order line asks for parts like its own."""
    part = table(spark, sf, "part")
    texts = part.select(F.col("p_partkey").cast("string").alias("product_id"), F.concat_ws(" ", "p_brand", "p_size").alias("text"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("query_id"),
        F.concat_ws(" ", F.split_part("p_brand", F.lit("#"), F.lit(2)), "p_size", "l_returnflag", "l_linestatus", F.concat(F.lit("line"), F.col("l_linenumber"))).alias("query_text"),
    )
    return texts, lines


@check("sparse_topk_many", MANY)
def _(spark, sf):
    return ts.sparse_topk(*parts_and_lines(spark, sf), 5).withColumn("score", F.round("score", 6))


@check("sparse_topk_many_bounded", MANY)
def _(spark, sf):
    return blockmax.bounded_topk(*parts_and_lines(spark, sf), 5).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- hybrid

ZERO = f"[0.0::double for i in range({DIM})]"
VECTORS = f"""cv AS MATERIALIZED (SELECT c.*, coalesce(e.embedding::double[], {ZERO}) AS v FROM c LEFT JOIN embeddings e ON e.vec_id = c.p_partkey),
qv AS MATERIALIZED (SELECT q.*, coalesce(e.embedding::double[], {ZERO}) AS qvec FROM q LEFT JOIN embeddings e ON e.vec_id = q.idx)"""
NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
COSINE = lambda a, b: f"CASE WHEN {NORM(a)} = 0 OR {NORM(b)} = 0 THEN 0 ELSE list_cosine_similarity({a}, {b}) END"
PTEXT = "SELECT product_id AS id, 'text' AS field, 1.0::double AS boost, 'product_class: ' || upper(product_class) || ' | product_name: ' || product_name || ' | product_description: ' || product_description AS text FROM c"
QTEXT = "SELECT query_id, query_text || coalesce(' | product_class: ' || upper(product_class), '') AS text FROM q"


def hybrid(k):
    return f"""{CQ}, {VECTORS}, {bm25(PTEXT, QTEXT, condition(), JOIN_CQ)},
dense AS (SELECT query_id, c.product_id AS id, {rounded(COSINE('qvec', 'v'), 9)} AS score FROM qv q JOIN cv c ON {condition()}),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM dense),
lists AS (SELECT query_id, 'dense' AS source, id, score FROM dr WHERE position <= {6 * k} UNION ALL SELECT query_id, 'sparse', id, score FROM ranked WHERE position <= {6 * k}),
st AS (SELECT query_id, source, avg(score) AS mu, stddev_samp(score) AS sd, max(score) = min(score) AS flat FROM lists GROUP BY ALL),
fused AS (SELECT query_id, id AS product_id, {rounded('sum(CASE WHEN flat OR sd IS NULL THEN 0.5::double ELSE (score - (mu - 3 * sd)) / (6 * sd) END)', 9)} AS score FROM lists JOIN st USING (query_id, source) GROUP BY ALL),
best AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS int) AS position FROM fused)"""


@check("dbsf_fusion", f"WITH {hybrid(20)} SELECT query_id, product_id, {rounded('score', 6)} AS score, position FROM best WHERE position <= 120")
def _(spark, sf):
    lists = rt.candidate_lists(vector_products(spark, sf), vector_queries(spark, sf), 120)
    return rt.dbsf_fusion(lists, 120).withColumn("score", F.round("score", 6))


@check("hybrid_search", f"WITH {hybrid(20)} SELECT query_id, product_id, {rounded('score', 6)} AS score, position, product_name, product_class, array_to_string(color, '|') AS color, price FROM best JOIN c USING (product_id) WHERE position <= 20")
def _(spark, sf):
    p = vector_products(spark, sf)
    hits = rt.with_payload(rt.hybrid_search(p, vector_queries(spark, sf)), p)
    return hits.select("query_id", "product_id", F.round("score", 6).alias("score"), "position", "product_name", "product_class", F.array_join("color", "|").alias("color"), "price")


@check("search_batch", f"WITH {CQ}, {bm25(FIELDS, 'SELECT query_id, query_text AS text FROM q', condition(), JOIN_CQ)} SELECT q.query_id, coalesce(string_agg(id, '|' ORDER BY position), '') AS product_ids FROM q LEFT JOIN (SELECT * FROM ranked WHERE position <= 10) r USING (query_id) GROUP BY ALL")
def _(spark, sf):
    asked = queries(spark, sf)
    return rt.result_lists(asked, ts.fielded_search(products(spark, sf), asked)).withColumn("product_ids", F.array_join("product_ids", "|"))


NUMBERS = {c: f"coalesce({'ln(1 + ' if log else ''}least(greatest({c}, 0), {top}::double){')' if log else ''} / {f'ln(1 + {top}::double)' if log else f'{top}::double'}, 0)" for c, (top, log) in rt.NUMBER_SPACES.items()}


@check("numeric_score", f"WITH {duck('c')} SELECT product_id, " + ", ".join(f"{rounded(e, 6)} AS {c}" for c, e in NUMBERS.items()) + " FROM c")
def _(spark, sf):
    return products(spark, sf).select("product_id", *[F.round(F.coalesce(rt.numeric_score(F.col(c), *rt.NUMBER_SPACES[c]), F.lit(0.0)), 6).alias(c) for c in rt.NUMBER_SPACES])


@check("multi_attribute_search", f"""WITH {CQ}, {VECTORS}, s AS (SELECT query_id, c.product_id, {rounded(f"{COSINE('qvec', 'v')} + coalesce(cast(q.product_class = c.product_class AS int), 0) + coalesce(rating_count_weight, 0) * {NUMBERS['rating_count']} + coalesce(rating_weight, 0) * {NUMBERS['average_rating']} + coalesce(price_weight, 0) * {NUMBERS['price']}", 9)} AS score
 FROM qv q JOIN cv c ON {condition()}), r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS int) AS position FROM s)
 SELECT query_id, product_id, {rounded('score', 6)} AS score, position FROM r WHERE position <= 20""")
def _(spark, sf):
    return rt.multi_attribute_search(vector_products(spark, sf), vector_queries(spark, sf)).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- boosts

QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{l}' AS label, list_sort(list({c}::double))[1 + cast(floor({p}::double * (count({c}) - 1)) AS bigint)] AS value FROM c WHERE {c} IS NOT NULL"
    for c in boosting.STAT_COLUMNS for l, p in boosting.POINTS.items()
)
RULES = f"""stats AS ({QUANTILES}), rules AS (""" + " UNION ALL ".join(
    f"SELECT query_id, '{f}' AS field, '{op}' AS op, {'trunc(value)' if f == 'rating_count' else 'value'} AS bound, greatest(-0.9::double, least(0.9::double, {factor}::double * {'abs(' + p + ')' if f == 'price' else p})) AS boost FROM q JOIN stats ON name = '{f}' AND label = '{l}' WHERE {p} * {sign} > 0"
    for p, f, sign, op, l, factor in boosting.BOOST_RULES
) + ")"


@check("floor_quantiles", f"WITH {duck('c')} {QUANTILES}")
def _(spark, sf):
    return boosting.floor_quantiles(products(spark, sf))


@check("boost_rules", f"WITH {CQ}, {RULES} SELECT query_id, field, op, bound, {rounded('boost', 6)} AS boost FROM rules")
def _(spark, sf):
    rules = boosting.boost_rules(queries(spark, sf), boosting.floor_quantiles(products(spark, sf)))
    return rules.withColumn("boost", F.round("boost", 6))


@check("boost_apply", f"""WITH {CQ}, {RULES}, {bm25(FIELDS, 'SELECT query_id, query_text AS text FROM q', condition(), JOIN_CQ)}, hits AS (SELECT query_id, id AS product_id, score FROM ranked WHERE position <= 60),
 b AS (SELECT h.query_id, h.product_id, h.score, coalesce(sum(boost), 0) AS boost FROM hits h JOIN c USING (product_id) LEFT JOIN rules r ON r.query_id = h.query_id AND
  CASE field WHEN 'price' THEN CASE op WHEN '<=' THEN price <= bound ELSE price >= bound END WHEN 'average_rating' THEN CASE op WHEN '<=' THEN average_rating <= bound ELSE average_rating >= bound END
  ELSE CASE op WHEN '<=' THEN rating_count <= bound ELSE rating_count >= bound END END GROUP BY ALL),
 s AS (SELECT *, {rounded('score * (1 + boost)', 9)} AS boosted FROM b), r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, product_id) AS int) AS position FROM s)
 SELECT query_id, product_id, {rounded('boost', 6)} AS boost, {rounded('boosted', 6)} AS boosted, position FROM r WHERE position <= 20""")
def _(spark, sf):
    p, q = products(spark, sf), queries(spark, sf)
    hits = ts.fielded_search(p, q, 60)
    out = boosting.boost_apply(hits, boosting.boost_rules(q, boosting.floor_quantiles(p)), p)
    return out.select("query_id", "product_id", F.round("boost", 6).alias("boost"), F.round("boosted", 6).alias("boosted"), "position")


# ---------------------------------------------------------------- query sets

PARAMS = ["product_class", "color", "material", "style", "color_negated", "material_negated", "style_negated", "rating_min", "rating_count_min", "price_max", "rating_weight", "rating_count_weight", "price_weight"]


def param_text(p):
    return f"array_to_string({p}, '|')" if p in filters.LIST_PARAMS else f"cast({p} AS varchar)"


def spark_text(p):
    return (F.array_join(p, "|") if p in filters.LIST_PARAMS else F.col(p).cast("string")).alias(p)


@check("query_mode", f"""WITH {duck('q')} SELECT 'gt' AS mode, query_id, product_class, price_max, len(color) AS colors FROM q UNION ALL SELECT 'none', query_id, NULL, NULL, NULL FROM q
 UNION ALL SELECT 'nlq', query_id, CASE WHEN price_max > 0 THEN upper(query_text) END, CASE WHEN price_max > 0 THEN price_max / 2 END, NULL FROM q""")
def _(spark, sf):
    q = queries(spark, sf)
    extracted = q.filter("price_max > 0").select("query_id", F.upper("query_text").alias("product_class"), (F.col("price_max") / 2).alias("price_max"))
    shown = lambda mode, df: df.select(F.lit(mode).alias("mode"), "query_id", "product_class", "price_max", F.when(F.col("color").isNotNull(), F.size("color")).cast("long").alias("colors"))
    return shown("gt", rt.query_mode(q, "gt")).unionByName(shown("none", rt.query_mode(q, "none"))).unionByName(shown("nlq", rt.query_mode(q, "nlq", extracted)))


ALL_PARAMS = " UNION ALL ".join(f"SELECT query_id, '{p}' AS name, coalesce({param_text(p)}, '') AS value FROM q WHERE {p} IS NOT NULL" for p in PARAMS)


@check("restrict_params", f"WITH {duck('q')}, a AS ({ALL_PARAMS}) SELECT query_id, name, value FROM a WHERE name IN ('color', 'price_max', 'rating_weight')")
def _(spark, sf):
    kept = rt.restrict_params(rt.params_map(queries(spark, sf)), ["color", "price_max", "rating_weight", "natural_query"])
    return kept.select("query_id", F.explode("params").alias("name", "value"))


@check("resume_missing", f"WITH {duck('q')} SELECT query_id, query_text FROM q WHERE NOT coalesce(price_max > 0, false)")
def _(spark, sf):
    q = queries(spark, sf)
    return rt.resume_missing(q, q.filter("price_max > 0")).select("query_id", "query_text")
