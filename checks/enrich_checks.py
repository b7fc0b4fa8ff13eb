"""Enrichment, response parsing, parameter extraction and reranking."""

from pyspark.sql import functions as F

from checks.catalog_checks import draw, strip
from checks.fixtures import duck, table, view
from checks.registry import check, rounded
from checks.queryset_checks import choose_sql, pick_sql
from checks.retrieval_checks import CQ, FIELDS, JOIN_CQ, TOKENS, bm25, condition
from shelfrank.operators import enrich as en, rerank as rr, textsearch as ts

SEED = 42


def products(spark, sf):
    return view(spark, sf, "c")


def queries(spark, sf):
    return view(spark, sf, "q")


def hits(spark, sf, k=20):
    return ts.fielded_search(products(spark, sf), queries(spark, sf), k)


def hits_sql(k):
    return f"{CQ}, {bm25(FIELDS, 'SELECT query_id, query_text AS text FROM q', condition(), JOIN_CQ)}, hits AS (SELECT query_id, id AS product_id, position FROM ranked WHERE position <= {k})"


GROUPED = "grouped AS (SELECT product_class, query_id, count(*) OVER (PARTITION BY product_class) AS class_queries FROM q WHERE query_type <> 'synth' AND product_class <> '' AND query_id IN (SELECT query_id FROM hits))"


@check("group_by_class", f"WITH {hits_sql(20)}, {GROUPED} SELECT * FROM grouped")
def _(spark, sf):
    return en.group_by_class(queries(spark, sf), hits(spark, sf))


@check("class_descriptions", f"""WITH {hits_sql(20)}, {GROUPED}, d AS (SELECT DISTINCT g.product_class, p.product_description FROM grouped g JOIN hits h USING (query_id) JOIN c p ON p.product_id = h.product_id)
 SELECT product_class, position, product_description FROM (SELECT *, cast(row_number() OVER (PARTITION BY product_class ORDER BY length(product_description) DESC, product_description) AS int) AS position FROM d) x WHERE position <= 10""")
def _(spark, sf):
    found = hits(spark, sf)
    return en.class_descriptions(en.group_by_class(queries(spark, sf), found), found, products(spark, sf))


@check("mine_class_terms", f"""WITH {duck('c')}, w AS MATERIALIZED (SELECT doc_id, lang AS product_class, {TOKENS('text')} AS w FROM documents),
 ph AS (SELECT product_class, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM w),
 pc AS (SELECT product_class, term, count(*) AS df FROM ph GROUP BY ALL), ov AS (SELECT term, sum(df) AS df_all FROM pc GROUP BY ALL),
 s AS (SELECT product_class, term, df, {rounded('df * ln((SELECT count(*) FROM documents) / df_all)', 9)} AS score FROM pc JOIN ov USING (term) WHERE df >= 2 AND term NOT IN (SELECT lower(x) FROM (SELECT DISTINCT unnest(color) AS x FROM c) y))
 SELECT product_class, position, term, df, {rounded('score', 6)} AS score FROM (SELECT *, cast(row_number() OVER (PARTITION BY product_class ORDER BY score DESC, term) AS int) AS position FROM s) z WHERE position <= 8""")
def _(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("lang").alias("product_class"), "text")
    vocabulary = products(spark, sf).select(F.explode("color").alias("value")).distinct()
    return en.mine_class_terms(texts, vocabulary).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- responses

FENCED = f"""{strip("regexp_replace(regexp_replace(regexp_replace(" + strip('response_text') + ", '^```[^\\n]*\\n', ''), '^```', ''), '```$', '')")}"""
LIST_OF = lambda t: f"CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.{t}') = 'ARRAY' THEN array_to_string(json_extract_string(body, '$.{t}[*]'), '|') ELSE '' END AS {t}"


@check("parse_feature_response", f"WITH {duck('responses')}, r AS (SELECT *, {FENCED} AS body FROM responses) SELECT key, {', '.join(LIST_OF(t) for t in en.FEATURE_TYPES)} FROM r")
def _(spark, sf):
    return en.parse_feature_response(view(spark, sf, "responses")).select("key", *[F.array_join(t, "|").alias(t) for t in en.FEATURE_TYPES])


UNFENCED = strip("regexp_replace(regexp_replace(" + strip("response_text") + ", '^```(json)?', ''), '```$', '')")


@check("parse_param_response", f"""WITH {duck('responses')}, r AS (SELECT *, {UNFENCED} AS body FROM responses), j AS (SELECT *, json_valid(body) AND body <> '' AS valid FROM r)
 SELECT key, CASE WHEN {strip('response_text')} = '' THEN NULL WHEN body = '' THEN '{en.EMPTY_RESPONSE}' WHEN NOT valid THEN '{en.INVALID_JSON}' WHEN json_type(body) <> 'OBJECT' THEN '{en.NOT_A_DICTIONARY}' END AS error,
 CASE WHEN valid THEN body ->> '$.color' END AS color, CASE WHEN valid THEN array_to_string(json_extract_string(body, '$.material[*]'), '|') END AS material, CASE WHEN valid THEN cast(body ->> '$.price_max' AS double) END AS price_max FROM j""".replace("CASE WHEN valid THEN array_to_string(json_extract_string(body, '$.material[*]'), '|') END", "CASE WHEN valid AND json_type(body, '$.material') = 'ARRAY' THEN array_to_string(json_extract_string(body, '$.material[*]'), '|') END"))
def _(spark, sf):
    parsed = en.parse_param_response(view(spark, sf, "responses"))
    return parsed.select("key", "error", F.array_join("color", "|").alias("color"), F.array_join("material", "|").alias("material"), "price_max")


# ---------------------------------------------------------------- parameters from text


@check("prompt_vocab", f"WITH {duck('c')} SELECT category, v AS value FROM (SELECT DISTINCT 'color' AS category, unnest(color) AS v FROM c UNION SELECT 'material', unnest(material) FROM c UNION SELECT 'style', unnest(style) FROM c UNION SELECT 'product_class', product_class FROM c) x")
def _(spark, sf):
    return en.prompt_vocab(products(spark, sf))


ASK_SQL = f"""asks AS (SELECT product_id AS query_id, 'Old World ' || color[1] || ' ' || product_class || ', not ' || coalesce(material[1], 'wood') || ' material, ' ||
 CASE p_partkey % 4 WHEN 0 THEN 'under $' || rating_count WHEN 1 THEN 'with more than 3.5 stars rating' WHEN 2 THEN 'with more than ' || rating_count || ' ratings' ELSE 'for ' || style[1] || ' rooms' END AS query_text FROM c)"""
VOCAB = f"""vocab AS (SELECT category, v AS value, array_to_string({TOKENS('v')}, ' ') AS phrase FROM (SELECT DISTINCT 'color' AS category, unnest(color) AS v FROM c UNION SELECT 'material', unnest(material) FROM c UNION SELECT 'style', unnest(style) FROM c UNION SELECT 'product_class', product_class FROM c UNION SELECT 'style', 'Old World ' || color[1] || ' ' || product_class || ', not wood' FROM c) x)"""
GIVEN = lambda c, neg: f"""coalesce((SELECT array_to_string(list(value ORDER BY start, len, value), '|') FROM (SELECT value, min(start) AS start, arg_min(n, start) AS len FROM found f WHERE f.query_id = a.query_id AND category = '{c}' AND {'' if neg else 'NOT '}negated GROUP BY value) y), '') AS {c}{'_negated' if neg else ''}"""
LISTED = ", ".join(f"coalesce({c}{'_negated' if neg else ''}, '') AS {c}{'_negated' if neg else ''}" for neg in (False, True) for c in ("color", "material", "style"))
GATHER = ", ".join(f"array_to_string(list(value ORDER BY start, n, value) FILTER (category = '{c}' AND {'' if neg else 'NOT '}negated), '|') AS {c}{'_negated' if neg else ''}" for neg in (False, True) for c in ("color", "material", "style"))


@check("extract_params", f"""WITH {duck('c')}, {ASK_SQL}, {VOCAB}, t AS MATERIALIZED (SELECT query_id, {TOKENS('query_text')} AS w FROM asks),
 runs AS (SELECT query_id, n, start, array_to_string(w[start:start + n - 1], ' ') AS phrase, coalesce(start > 1 AND w[start - 1] = 'not', false) AS negated FROM t, range(1, 9) x(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS start) s),
 found AS (SELECT query_id, category, value, negated, min(start) AS start, min(n) AS n, max(length(phrase)) AS pl FROM runs JOIN vocab USING (phrase) GROUP BY ALL),
 g AS (SELECT query_id, {GATHER}, arg_max(value, pl * 1000 - start) FILTER (category = 'product_class' AND NOT negated) AS product_class FROM found GROUP BY query_id)
 SELECT a.query_id, {LISTED}, product_class, cast(nullif(regexp_extract(lower(query_text), 'under \\$?(\\d+(?:\\.\\d+)?)', 1), '') AS double) AS price_max,
 cast(nullif(regexp_extract(lower(query_text), 'more than (\\d+(?:\\.\\d+)?) stars', 1), '') AS double) AS rating_min, cast(nullif(regexp_extract(lower(query_text), 'more than (\\d+(?:\\.\\d+)?) ratings', 1), '') AS double) AS rating_count_min,
 regexp_replace(query_text, '(, under \\$\\d+|, with more than \\d+ ratings|, with more than 3\\.5 stars rating)$', '') AS product_description
 FROM asks a LEFT JOIN g USING (query_id)""")
def _(spark, sf):
    p = products(spark, sf)
    n = F.col("p_partkey") % 4
    tail = (
        F.when(n == 0, F.concat(F.lit("under $"), "rating_count")).when(n == 1, F.lit("with more than 3.5 stars rating"))
        .when(n == 2, F.concat(F.lit("with more than "), "rating_count", F.lit(" ratings"))).otherwise(F.concat(F.lit("for "), F.get("style", F.lit(0)), F.lit(" rooms")))
    )
    text = F.concat(F.lit("Old World "), F.get("color", F.lit(0)), F.lit(" "), "product_class", F.lit(", not "), F.coalesce(F.get("material", F.lit(0)), F.lit("wood")), F.lit(" material, "), tail)
    asks = p.select(F.col("product_id").alias("query_id"), text.alias("query_text"))
    # Values of six and more words as well.
    long = p.select(F.lit("style").alias("category"), F.concat(F.lit("Old World "), F.get("color", F.lit(0)), F.lit(" "), "product_class", F.lit(", not wood")).alias("value")).distinct()
    out = en.extract_params(asks, en.prompt_vocab(p).union(long))
    lists = [f"{c}{s}" for c in ("color", "material", "style") for s in ("", "_negated")]
    return out.withColumns({c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in lists})


# ---------------------------------------------------------------- enrichment

SETS = {"USAGE_CONTEXTS": "lower(countryoforigin[1])", "FUNCTIONAL_FEATURES": "material[1]", "BENEFIT_PHRASES": "style[1]"}
FEATURES = "features AS (SELECT product_class, " + ", ".join(
    f"list(DISTINCT {SETS[t]} ORDER BY {SETS[t]}) FILTER ({SETS[t]} IS NOT NULL) AS {t}" if t in SETS else f"cast([] AS varchar[]) AS {t}" for t in en.FEATURE_TYPES
) + " FROM c GROUP BY ALL HAVING product_class <> 'PROMO')"


def features(spark, sf):
    sources = {"USAGE_CONTEXTS": F.lower(F.get("countryoforigin", F.lit(0))), "FUNCTIONAL_FEATURES": F.get("material", F.lit(0)), "BENEFIT_PHRASES": F.get("style", F.lit(0))}
    sets = [F.array_sort(F.collect_set(sources[t])).alias(t) if t in sources else F.array().cast("array<string>").alias(t) for t in en.FEATURE_TYPES]
    aggs = [s for t, s in zip(en.FEATURE_TYPES, sets) if t in sources]
    rest = [s for t, s in zip(en.FEATURE_TYPES, sets) if t not in sources]
    # A whole class without features shows that its queries drop out.
    return products(spark, sf).filter("product_class <> 'PROMO'").groupBy("product_class").agg(*aggs).select("*", *rest)


FILLED = "[" + ", ".join(f"'{t}'" for t in ("FUNCTIONAL_FEATURES", "USAGE_CONTEXTS", "BENEFIT_PHRASES")) + "]"
ENRICHED = f"""{FEATURES}, drawn AS (SELECT q.*, {pick_sql(FILLED, draw(SEED, 'feature', 'query_id'))} AS kind, f.USAGE_CONTEXTS, f.FUNCTIONAL_FEATURES, f.BENEFIT_PHRASES FROM q JOIN features f USING (product_class)),
termed AS (SELECT *, CASE kind WHEN 'USAGE_CONTEXTS' THEN {pick_sql('USAGE_CONTEXTS', draw(SEED, 'term', 'query_id'))} WHEN 'FUNCTIONAL_FEATURES' THEN {pick_sql('FUNCTIONAL_FEATURES', draw(SEED, 'term', 'query_id'))}
  ELSE {pick_sql('BENEFIT_PHRASES', draw(SEED, 'term', 'query_id'))} END AS term FROM drawn),
enriched AS (SELECT * REPLACE (CASE kind WHEN 'USAGE_CONTEXTS' THEN query_text || ', for ' || term ELSE term || ' ' || query_text END AS query_text) FROM termed)"""


def enriched(spark, sf):
    return en.enrich_queries(queries(spark, sf).withColumn("product_description", F.col("query_text")), features(spark, sf), SEED)


@check("enrich_queries", f"WITH {CQ}, {ENRICHED} SELECT query_id, query_text, query_text AS product_description FROM enriched")
def _(spark, sf):
    return enriched(spark, sf).select("query_id", "query_text", "product_description")


ACCEPT = f"""{CQ}, {ENRICHED}, {bm25(FIELDS, 'SELECT query_id, query_text AS text FROM enriched', condition(), JOIN_CQ)},
enough AS (SELECT query_id FROM ranked WHERE position <= 20 GROUP BY ALL HAVING count(*) >= 15)"""


def accepted(spark, sf):
    new = enriched(spark, sf)
    found = ts.fielded_search(products(spark, sf), new, 20)
    return en.accept_enriched(queries(spark, sf).withColumn("product_description", F.col("query_text")), new, found)


@check("accept_enriched", f"""WITH {ACCEPT} SELECT e.query_id, CASE WHEN n.query_id IS NULL THEN o.query_text ELSE e.query_text END AS query_text, n.query_id IS NOT NULL AS accepted,
 coalesce((SELECT string_agg(id, '|' ORDER BY position) FROM ranked r WHERE r.query_id = n.query_id AND position <= 20), '') AS product_ids FROM enriched e JOIN q o USING (query_id) LEFT JOIN enough n USING (query_id)""")
def _(spark, sf):
    from shelfrank.operators.retrieval import result_lists

    chosen, found = accepted(spark, sf)
    lists = result_lists(chosen, found).withColumn("product_ids", F.array_join("product_ids", "|"))
    return chosen.select("query_id", "query_text", "accepted").join(lists, "query_id")


@check("append_synth", f"WITH {duck('q')} SELECT query_id, query_text, query_type FROM q UNION ALL SELECT 'synth-' || item_id, text, 'synth' FROM benchmark")
def _(spark, sf):
    synthetic = table(spark, sf, "benchmark").select(F.concat(F.lit("synth-"), F.col("item_id")).alias("query_id"), F.col("text").alias("query_text"), F.lit("synth").alias("query_type"))
    return en.append_synth(queries(spark, sf), synthetic).select("query_id", "query_text", "query_type")


# ---------------------------------------------------------------- rerank


def candidates(spark, sf):
    return hits(spark, sf).select("query_id", "product_id", F.col("position").alias("rank"))


NUMBER = lambda c, missing: f"coalesce(cast({c} AS varchar), '{missing}')"
PLAIN = lambda c: f"coalesce(array_to_string({c}, ', '), '')"
TAIL = lambda sep: sep.join(f"'{label}: ' || {PLAIN(c)}" for label, c in (("Colors", "color"), ("Materials", "material"), ("Styles", "style"), ("Country", "countryoforigin")))
PIPES = f"""product_description || ' | Category: ' || product_class || ' | Price: $' || {NUMBER('price', '0')} || ' | Rating: ' || {NUMBER('average_rating', '0')} || ' | Rating Count: ' || {NUMBER('rating_count', '0')} || ' | ' || {TAIL(" || ' | ' || ")}"""
LINES = f"""product_description || chr(10) || 'Category: ' || product_class || chr(10) || 'Price: $' || {NUMBER('price', 'N/A')} || chr(10) || 'Rating: ' || {NUMBER('average_rating', 'N/A')} || ' (' || {NUMBER('rating_count', 'N/A')} || ' reviews)' || chr(10) || {TAIL(" || chr(10) || ")}"""


@check("rerank_content", f"WITH {hits_sql(20)} SELECT query_id, product_id, h.position AS rank, product_name AS title, {PIPES} AS pipes, {LINES} AS lines FROM hits h JOIN c USING (product_id)")
def _(spark, sf):
    p, found = products(spark, sf), candidates(spark, sf)
    pipes = rr.rerank_content(found, p).withColumnRenamed("content", "pipes")
    return pipes.join(rr.rerank_content(found, p, "lines").select("query_id", "product_id", F.col("content").alias("lines")), ["query_id", "product_id"])


RERANKED = f"""{hits_sql(20)}, qw AS (SELECT query_id, list_distinct({TOKENS('query_text')}) AS words FROM q),
 sc AS (SELECT query_id, product_id, product_name AS title, h.position AS first_rank, {rounded(f"len(list_intersect(words, list_concat({TOKENS('product_name')}, {TOKENS(PIPES)}))) / len(words)", 9)} AS score FROM hits h JOIN c USING (product_id) JOIN qw USING (query_id)),
 rk AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS int) AS rank FROM sc)"""


@check("rerank_topn", f"WITH {RERANKED} SELECT query_id, product_id, title, {rounded('score', 6)} AS score, first_rank, rank FROM rk WHERE rank <= 10")
def _(spark, sf):
    return rr.rerank_topn(queries(spark, sf), candidates(spark, sf), products(spark, sf)).withColumn("score", F.round("score", 6))


@check("rerank_batch", f"WITH {RERANKED} SELECT q.query_id, coalesce(string_agg(product_id, '|' ORDER BY rank), '') AS product_ids FROM q LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) r USING (query_id) GROUP BY ALL")
def _(spark, sf):
    from shelfrank.operators.retrieval import result_lists

    asked = queries(spark, sf)
    lists = result_lists(asked, hits(spark, sf))
    return rr.rerank_batch(asked, lists, products(spark, sf)).withColumn("product_ids", F.array_join("product_ids", "|"))
