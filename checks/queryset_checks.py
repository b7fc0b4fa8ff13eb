"""Query generation from the profile of the whole derived catalogue."""

from pyspark.sql import functions as F

from checks.catalog_checks import draw, strip
from checks.fixtures import SYSTEMS, duck, table, view
from checks.registry import check, rounded
from checks.retrieval_checks import ALL_PARAMS, FIELDS, PARAMS, bm25, condition
from shelfrank.operators import queryset as qs, retrieval as rt, textsearch as ts

SEED = 42
SLOTS = 25
ATTEMPTS = 3


def products(spark, sf):
    return view(spark, sf, "c")


def profile(spark, sf):
    return qs.class_profile(qs.top_classes(products(spark, sf)))


# ---------------------------------------------------------------- profile

CLEAN = f"lower({strip(chr(114) + 'egexp_replace(regexp_replace(v, ' + repr(chr(92) + 'd+' + chr(92) + 's*%').replace(chr(92) * 2, chr(92)) + ', ' + repr('') + ', ' + repr('g') + '), ' + repr(chr(92) + 's+').replace(chr(92) * 2, chr(92)) + ', ' + repr(' ') + ', ' + repr('g') + ')')})"
TOP = """top AS (SELECT c.* FROM c WHERE product_class IN (SELECT product_class FROM c WHERE product_class IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, product_class LIMIT 50))"""
STATS = "stats AS (SELECT product_class, " + ", ".join(
    f"{rounded(f'min({c}::double)', 2)} AS {s}_lo, {rounded(f'max({c}::double)', 2)} AS {s}_hi" for s, c in qs.STAT_COLUMNS.items()
) + " FROM top GROUP BY ALL)"
VALUES = f"vals AS (SELECT DISTINCT product_class, attribute, {CLEAN} AS value FROM (" + " UNION ALL ".join(
    f"SELECT product_class, '{a}' AS attribute, unnest({a}) AS v FROM top" for a in qs.ATTRIBUTES
) + f") x WHERE {CLEAN} <> '')"
PROFILE = f"""{duck('c')}, {TOP}, {STATS}, {VALUES},
sets AS (SELECT product_class, {', '.join(f"coalesce(list(value ORDER BY value) FILTER (attribute = '{a}'), []) AS {a}s" for a in qs.ATTRIBUTES)} FROM vals GROUP BY ALL),
prof AS (SELECT * FROM stats JOIN sets USING (product_class))"""


@check("top_classes", f"WITH {duck('c')}, {TOP} SELECT product_id, product_class FROM top")
def _(spark, sf):
    return qs.top_classes(products(spark, sf)).select("product_id", "product_class")


@check("class_stats", f"WITH {PROFILE} SELECT * FROM stats")
def _(spark, sf):
    return qs.class_stats(qs.top_classes(products(spark, sf)))


SHOW_SETS = ", ".join(f"array_to_string({a}s, '|') AS {a}s" for a in qs.ATTRIBUTES)


@check("class_value_sets", f"WITH {PROFILE} SELECT product_class, {SHOW_SETS} FROM sets")
def _(spark, sf):
    return qs.class_value_sets(qs.top_classes(products(spark, sf))).select("product_class", *[F.array_join(f"{a}s", "|").alias(f"{a}s") for a in qs.ATTRIBUTES])


@check("class_profile", f"WITH {PROFILE} SELECT product_class, {SHOW_SETS}, rating_lo, rating_hi, rating_count_lo, rating_count_hi, price_lo, price_hi FROM prof")
def _(spark, sf):
    return profile(spark, sf).withColumns({f"{a}s": F.array_join(f"{a}s", "|") for a in qs.ATTRIBUTES})


# ---------------------------------------------------------------- draws


def pick_sql(items, u):
    return f"({items})[1 + cast(floor({u} * len({items})) AS bigint)]"


def choose_sql(names, u):
    return pick_sql("[" + ", ".join(f"'{n}'" for n in names) + "]", u)


def stat_sql(stat, lo, hi, u):
    early = f"({lo} + ({hi} - {lo}) * (1.0::double - pow(1.0::double - {u}, {1 / 3!r}::double)))"
    late = f"({lo} + ({hi} - {lo}) * pow({u}, {1 / 3!r}::double))"
    return f"CASE {stat} WHEN 'rating' THEN {rounded(early, 1)} WHEN 'rating_count' THEN round_even({early} / 10, 0) * 10 WHEN 'price' THEN round_even({late} / 10, 0) * 10 ELSE 0 END"


LINE_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_quantity || '|' || l_extendedprice"
LINE_STAT = "CASE l_linenumber % 4 WHEN 0 THEN 'rating' WHEN 1 THEN 'rating_count' WHEN 2 THEN 'price' ELSE 'other' END"


def lines(spark, sf):
    df = table(spark, sf, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = F.col("l_linenumber") % 4
    stat = F.when(n == 0, "rating").when(n == 1, "rating_count").when(n == 2, "price").otherwise("other")
    return df.withColumn("k", key).withColumn("stat", stat)


@check("draw_stat", f"SELECT {LINE_KEY} AS k, {stat_sql(LINE_STAT, 'l_quantity', 'l_extendedprice', draw(SEED, 'stat', LINE_KEY))} AS value FROM lineitem")
def _(spark, sf):
    from shelfrank.functions.draws import uniform

    return lines(spark, sf).select("k", qs.draw_stat(F.col("stat"), F.col("l_quantity"), F.col("l_extendedprice"), uniform(SEED, "stat", "k")).alias("value"))


PHRASE_SQL = lambda stat, u: "CASE " + stat + " " + " ".join(f"WHEN '{s}' THEN {choose_sql(p, u)}" for s, p in qs.PHRASES.items()) + " END"


@check("draw_phrase", f"SELECT {LINE_KEY} AS k, {PHRASE_SQL(LINE_STAT, draw(SEED, 'phrase', LINE_KEY))} AS phrase FROM lineitem")
def _(spark, sf):
    from shelfrank.functions.draws import uniform

    return lines(spark, sf).select("k", qs.draw_phrase(F.col("stat"), uniform(SEED, "phrase", "k")).alias("phrase"))


def value_sql(items, u):
    usable = f"list_filter({items}, lambda v: v <> '' AND lower(v) <> 'unknown')"
    return f"coalesce({pick_sql(usable, u)}, '')"


@check("draw_category_value", f"WITH {PROFILE} SELECT product_id, {value_sql('materials', draw(SEED, 'value', 'product_id'))} AS value FROM c JOIN prof USING (product_class)")
def _(spark, sf):
    from shelfrank.functions.draws import uniform

    df = products(spark, sf).join(profile(spark, sf).select("product_class", "materials"), "product_class")
    return df.select("product_id", qs.draw_category_value(F.col("materials"), uniform(SEED, "value", "product_id")).alias("value"))


def text_sql(item, category, value):
    return f"CASE WHEN {category} IN ('material', 'color') THEN lower({value}) || ' ' || lower({item}) WHEN {category} = 'style' THEN lower({item}) || ' in ' || lower({value}) || ' style' ELSE '' END"


@check("render_text", f"WITH {duck('c')} SELECT product_id, a.category, {text_sql('product_name', 'a.category', 'a.value')} AS text FROM c, LATERAL (SELECT unnest(['material', 'color', 'style', 'price']) AS category, unnest([material[1], color[1], style[1], '1']) AS value) a")
def _(spark, sf):
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), v.alias("value")) for c, v in
                      [("material", F.get("material", F.lit(0))), ("color", F.get("color", F.lit(0))), ("style", F.get("style", F.lit(0))), ("price", F.lit("1"))]])
    df = products(spark, sf).withColumn("a", F.explode(pairs))
    return df.select("product_id", "a.category", qs.render_text(F.col("product_name"), F.col("a.category"), F.col("a.value")).alias("text"))


# ---------------------------------------------------------------- generation

KEY = "query_type || '|' || slot || '|' || attempt"
U = lambda tag: draw(SEED, tag, KEY)
SET_OF = lambda cat: f"CASE {cat} WHEN 'material' THEN materials WHEN 'color' THEN colors ELSE styles END"
SLOT_SQL = f"""raw_slots AS (SELECT t.query_type, s.slot, a.attempt FROM (VALUES ('simple'), ('negation'), ('number'), ('complex')) t(query_type), range(1, {SLOTS + 1}) s(slot), range(1, {ATTEMPTS + 1}) a(attempt)),
names AS (SELECT list(product_class ORDER BY product_class) AS classes FROM prof),
slots AS MATERIALIZED (SELECT r.*, p.* FROM (SELECT *, {pick_sql('classes', U('class'))} AS cls FROM raw_slots, names) r JOIN prof p ON p.product_class = r.cls)"""
ATTR = lambda names: f"SELECT *, {value_sql('set_of', U('value'))} AS value FROM (SELECT *, {SET_OF('category')} AS set_of FROM (SELECT *, {choose_sql(names, U('category'))} AS category FROM slots) x) y"
PARAM = lambda a, cat, val: f"nullif(CASE WHEN {cat} = '{a}' THEN {val} END, '') AS {a}"
NULLS = lambda *names: ", ".join(f"NULL AS {n}" for n in names)
QID = "query_type || '-' || lpad(slot::varchar, 3, '0') AS query_id"
HEAD = f"{QID}, query_type, slot, attempt, product_class"
NUM = lambda x: f"CASE WHEN {x} <> 0 THEN {x} END"
SAID = lambda part, neg: f"CASE WHEN {neg} THEN 'not ' || {part}_value || ' ' || {part} ELSE {text_sql('product_class', part, part + '_value')} END"
GENERATED = f"""{PROFILE}, {SLOT_SQL},
g_simple AS (SELECT {HEAD}, {text_sql('product_class', 'category', 'value')} AS query_text, {text_sql('product_class', 'category', 'value')} AS product_description,
  {', '.join(PARAM(a, 'category', 'value') for a in qs.ATTRIBUTES)}, {NULLS('material_negated', 'color_negated', 'style_negated', 'rating_min', 'rating_count_min', 'price_max', 'rating_weight', 'rating_count_weight', 'price_weight')}
  FROM ({ATTR(qs.ATTRIBUTES)}) z WHERE query_type = 'simple'),
g_negation AS (SELECT {HEAD}, {SAID('first', 'neg')} || ', ' || {SAID('second', 'NOT neg')} AS query_text, query_text AS product_description,
  {', '.join(PARAM(a, 'CASE WHEN neg THEN second ELSE first END', 'CASE WHEN neg THEN second_value ELSE first_value END') for a in qs.ATTRIBUTES)},
  {', '.join(PARAM(a, 'CASE WHEN neg THEN first ELSE second END', 'CASE WHEN neg THEN first_value ELSE second_value END').replace(' AS ' + a, ' AS ' + a + '_negated') for a in qs.ATTRIBUTES)},
  {NULLS('rating_min', 'rating_count_min', 'price_max', 'rating_weight', 'rating_count_weight', 'price_weight')}
  FROM (SELECT *, {value_sql('s1', U('first_value'))} AS first_value, {value_sql('s2', U('second_value'))} AS second_value FROM
   (SELECT *, {SET_OF('first')} AS s1, {SET_OF('second')} AS s2, {U('negated')} < 0.5 AS neg FROM
    (SELECT *, {pick_sql("list_filter(['material', 'color', 'style'], lambda v: v <> first)", U('second'))} AS second FROM (SELECT *, {choose_sql(qs.ATTRIBUTES, U('first'))} AS first FROM slots WHERE query_type = 'negation') a) b) c) d),
g_number AS (SELECT {HEAD}, {text_sql('product_class', 'category', 'value')} || CASE stat WHEN 'rating' THEN ', with more than ' || printf('%.1f', bound) || ' stars rating'
   WHEN 'rating_count' THEN ', with more than ' || cast(trunc(bound) AS bigint) || ' ratings' ELSE ', under $' || cast(trunc(bound) AS bigint) END AS query_text, {text_sql('product_class', 'category', 'value')} AS product_description,
  {', '.join(PARAM(a, 'category', 'value') for a in qs.ATTRIBUTES)}, {NULLS('material_negated', 'color_negated', 'style_negated')},
  CASE WHEN stat = 'rating' THEN {NUM('bound')} END AS rating_min, CASE WHEN stat = 'rating_count' THEN {NUM('bound')} END AS rating_count_min, CASE WHEN stat = 'price' THEN {NUM('bound')} END AS price_max, {NULLS('rating_weight', 'rating_count_weight', 'price_weight')}
  FROM (SELECT *, coalesce({stat_sql('stat', 'lo', 'hi', U('stat_value'))}, 2) AS bound FROM (SELECT *, CASE stat WHEN 'rating' THEN rating_lo WHEN 'rating_count' THEN rating_count_lo ELSE price_lo END AS lo,
    CASE stat WHEN 'rating' THEN rating_hi WHEN 'rating_count' THEN rating_count_hi ELSE price_hi END AS hi FROM (SELECT *, {choose_sql(qs.STATS, U('stat'))} AS stat FROM ({ATTR(qs.ATTRIBUTES)}) z WHERE query_type = 'number') a) b) c),
g_complex AS (SELECT {HEAD}, trim({PHRASE_SQL('stat', U('phrase'))} || ' ' || {text_sql('product_class', 'category', 'value')}) AS query_text, query_text AS product_description,
  {', '.join(PARAM(a, 'category', 'value') for a in qs.ATTRIBUTES)}, {NULLS('material_negated', 'color_negated', 'style_negated', 'rating_min', 'rating_count_min', 'price_max')},
  CASE WHEN stat = 'rating' THEN 1 END AS rating_weight, CASE WHEN stat = 'rating_count' THEN 1 END AS rating_count_weight, CASE WHEN stat = 'price' THEN -1 END AS price_weight
  FROM (SELECT *, {choose_sql(qs.STATS, U('stat'))} AS stat FROM ({ATTR(('color', 'material'))}) z WHERE query_type = 'complex') a)"""
TEXTS = ["query_text", "product_description", "product_class", *[a + s for a in qs.ATTRIBUTES for s in ("", "_negated")]]
OUT = "query_id, query_type, cast(slot AS int) AS slot, cast(attempt AS int) AS attempt, " + ", ".join(f"cast({t} AS varchar) AS {t}" for t in TEXTS) + ", " + ", ".join(f"cast({n} AS double) AS {n}" for n in qs.NUMBER_PARAMS)
ALL_GENERATED = " UNION ALL ".join(f"SELECT {OUT} FROM g_{t}" for t in qs.QUERY_TYPES)
COUNTS = {t: SLOTS for t in qs.QUERY_TYPES}


def generated(spark, sf):
    return qs.gen_queries(profile(spark, sf), COUNTS, ATTEMPTS, SEED)


for kind in qs.QUERY_TYPES:
    check(f"gen_{kind}", f"WITH {GENERATED} SELECT {OUT} FROM g_{kind}")(
        lambda spark, sf, t=kind: qs.GENERATORS[t](qs.query_slots(profile(spark, sf), {t: SLOTS}, ATTEMPTS, SEED), SEED)
    )
check("gen_queries", f"WITH {GENERATED} {ALL_GENERATED}")(generated)


@check("cleanup_params", f"WITH {duck('q')} SELECT query_id, " + ", ".join(
    f"CASE WHEN len({p}) > 0 THEN array_to_string({p}, '|') END AS {p}" if "color" in p or "material" in p or "style" in p else f"nullif({p}, '') AS {p}" if p == "product_class" else f"nullif({p}, 0) AS {p}"
    for p in PARAMS) + " FROM q")
def _(spark, sf):
    clean = qs.cleanup_params(view(spark, sf, "q"))
    return clean.select("query_id", *[F.array_join(p, "|").alias(p) if clean.schema[p].dataType.typeName() == "array" else p for p in PARAMS])


# ---------------------------------------------------------------- validation

WANTED = {"simple": 6, "negation": 6, "number": 6, "complex": 6}
AS_LIST = ", ".join(f"CASE WHEN {a}{s} IS NULL THEN [] ELSE [{a}{s}] END AS {a}{s}" for a in qs.ATTRIBUTES for s in ("", "_negated"))
VALIDATED = f"""{GENERATED}, gen AS MATERIALIZED ({ALL_GENERATED}), q AS MATERIALIZED (SELECT query_id || '#' || attempt AS query_id, product_description, product_class, rating_min, rating_count_min, price_max, {AS_LIST} FROM gen),
{bm25(FIELDS, 'SELECT query_id, product_description AS text FROM q', condition(), 'JOIN q USING (query_id) JOIN c ON c.product_id = id')},
hits AS (SELECT query_id, id AS product_id, position FROM ranked WHERE position <= 20),
enough AS (SELECT query_id, count(*) AS n_hits FROM hits GROUP BY ALL HAVING count(*) >= 15),
passed AS (SELECT g.*, e.n_hits, g.query_id || '#' || attempt AS key FROM gen g JOIN enough e ON e.query_id = g.query_id || '#' || attempt),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY attempt) AS r FROM passed) x WHERE r = 1),
accepted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY slot) AS place FROM firsts) x WHERE place <= 6)"""


def validated(spark, sf):
    p = products(spark, sf)
    search = lambda q: ts.fielded_search(p, q, 20, "product_description").select("query_id", "product_id", "position")
    return qs.validate_queries(generated(spark, sf), search, WANTED)


@check("validate_queries", f"WITH {VALIDATED} SELECT a.query_id, a.attempt, a.query_text, a.n_hits, h.product_id, h.position FROM accepted a JOIN hits h ON h.query_id = a.key")
def _(spark, sf):
    queries, hits = validated(spark, sf)
    return queries.select("query_id", "attempt", "query_text", "n_hits").join(hits, "query_id")


RENUMBER_Q = """named AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'negation' WHEN 2 THEN 'number' WHEN 3 THEN 'complex' ELSE 'synth' END || '-' || (c_custkey * 7 + 3) AS query_id, c_custkey FROM customer),
kept AS (SELECT * FROM (SELECT query_id, c_custkey, split_part(query_id, '-', 1) AS t, row_number() OVER (PARTITION BY split_part(query_id, '-', 1) ORDER BY cast(split_part(query_id, '-', 2) AS int), query_id) AS place FROM named) x WHERE place <= 100)"""


@check("renumber_queries", f"""WITH {RENUMBER_Q} SELECT t || '-' || lpad(place::varchar, 3, '0') AS query_id, c_custkey, o_orderkey FROM kept JOIN orders ON o_custkey = c_custkey""")
def _(spark, sf):
    kinds = F.array(*[F.lit(t) for t in ("simple", "negation", "number", "complex", "synth")])
    named = table(spark, sf, "customer").select(F.concat(F.get(kinds, (F.col("c_custkey") % 5).cast("int")), F.lit("-"), (F.col("c_custkey") * 7 + 3).cast("string")).alias("query_id"), "c_custkey")
    results = table(spark, sf, "orders").join(named.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("query_id", "o_orderkey")
    queries, moved = qs.renumber_queries(named, results)
    return queries.join(moved, "query_id")


@check("join_synthetic", f"WITH {duck('result_map')} SELECT r.query_id, l.n, array_to_string(product_ids, '|') AS product_ids FROM result_map r JOIN (SELECT 'synth-' || l_partkey AS query_id, count(*) AS n FROM lineitem GROUP BY ALL) l USING (query_id)")
def _(spark, sf):
    queries = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("synth-"), F.col("l_partkey")).alias("query_id")).agg(F.count("*").alias("n"))
    return qs.join_synthetic(queries, view(spark, sf, "result_map")).withColumn("product_ids", F.array_join("product_ids", "|"))


@check("type_breakdown", f"""WITH {duck('q')}, a AS (SELECT query_type, count(*) AS actual FROM q GROUP BY ALL), e AS (SELECT * FROM (VALUES ('simple', 60::bigint), ('negation', 100::bigint), ('number', 90::bigint), ('synth', 10::bigint)) v(query_type, expected))
 SELECT query_type, coalesce(actual, 0) AS actual, coalesce(expected, 0) AS expected, greatest(coalesce(expected, 0) - coalesce(actual, 0), 0) AS missing, CASE WHEN expected > 0 THEN {rounded('coalesce(actual, 0) / expected * 100', 1)} END AS percent FROM a FULL JOIN e USING (query_type)""")
def _(spark, sf):
    return qs.type_breakdown(view(spark, sf, "q"), {"simple": 60, "negation": 100, "number": 90, "synth": 10})


@check("distinct_param_names", f"WITH {duck('q')}, a AS ({ALL_PARAMS}) SELECT DISTINCT name FROM a")
def _(spark, sf):
    return qs.distinct_param_names(rt.params_map(view(spark, sf, "q")))


@check("scale_weights", f"WITH {duck('q')} SELECT query_id, price_weight / 2 AS price_weight, rating_weight / 2 AS rating_weight, rating_count_weight / 2 AS rating_count_weight, price_max FROM q")
def _(spark, sf):
    return qs.scale_weights(view(spark, sf, "q")).select("query_id", "price_weight", "rating_weight", "rating_count_weight", "price_max")
