"""Catalogue cleaning on the raw catalogue derived from all parts, lines and documents."""

from pyspark.sql import functions as F

from checks.fixtures import class_mapping_duck, class_mapping_frame, duck, lookup_duck, lookup_frame, table, view
from checks.registry import check, rounded
from shelfrank.operators import catalog as cat
from shelfrank.session import materialize

SEED = 42


def draw(seed, tag, key):
    """DuckDB text of the hash draw."""
    return f"(cast(('0x' || substr(md5('{seed}|{tag}|' || {key}), 1, 8)) AS bigint) / 4294967296.0::double)"


def strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def joined(column):
    return F.array_join(column, "|").alias(column)


LISTS = ["material", "style", "color", "countryoforigin"]
PARSE = f"""items AS (SELECT product_id, unnest(string_split(product_features, '|')) AS item, generate_subscripts(string_split(product_features, '|'), 1) AS i FROM p),
kv AS (SELECT product_id, i, {strip("split_part(item, ':', 1)")} AS k, {strip("substr(item, instr(item, ':') + 1)")} AS v FROM items WHERE contains(item, ':')),
kv1 AS (SELECT product_id, k, min(i) AS i, arg_max(v, i) AS v FROM kv GROUP BY ALL),
parsed AS (SELECT p.*, m.* EXCLUDE (product_id) FROM p LEFT JOIN (SELECT product_id,
  list(v ORDER BY i) FILTER (contains(lower(k), 'material')) AS material, list(v ORDER BY i) FILTER (contains(lower(k), 'style')) AS style,
  list(v ORDER BY i) FILTER (contains(lower(k), 'color')) AS color, list(v ORDER BY i) FILTER (contains(lower(k), 'country')) AS countryoforigin
  FROM kv1 GROUP BY product_id) m USING (product_id)),
filtered AS (SELECT * EXCLUDE (style, color), list_sort(style) AS style, list_sort(color) AS color FROM parsed
  WHERE material IS NOT NULL AND style IS NOT NULL AND color IS NOT NULL AND countryoforigin IS NOT NULL)"""


def norm_cte(name):
    return f"""n_{name} AS (SELECT product_id, list(value ORDER BY p1, p2) AS vals FROM (
  SELECT product_id, value, min(i) AS p1, arg_min(j, i) AS p2 FROM (
    SELECT product_id, i, unnest(targets) AS value, generate_subscripts(targets, 1) AS j FROM (
      SELECT f.product_id, f.i, coalesce(l.normalized, [f.raw]) AS targets FROM (
        SELECT product_id, lower({strip('item')}) AS raw, i FROM (SELECT product_id, unnest({name}) AS item, generate_subscripts({name}, 1) AS i FROM filtered) z) f
      LEFT JOIN (SELECT * FROM lookup WHERE category = '{name}') l ON l.raw = f.raw) y) x
  WHERE value IN (SELECT unnest(normalized) FROM lookup WHERE category = '{name}') GROUP BY product_id, value) w GROUP BY product_id)"""


NORMALIZE = PARSE + f", {lookup_duck()}, " + ", ".join(norm_cte(c) for c in LISTS) + """,
normalized AS (SELECT f.* EXCLUDE (material, style, color, countryoforigin), coalesce(a.vals, []) AS material, coalesce(b.vals, []) AS style, coalesce(c.vals, []) AS color, coalesce(d.vals, []) AS countryoforigin
 FROM filtered f LEFT JOIN n_material a USING (product_id) LEFT JOIN n_style b USING (product_id) LEFT JOIN n_color c USING (product_id) LEFT JOIN n_countryoforigin d USING (product_id)),
filled AS (SELECT * EXCLUDE (product_description), coalesce(product_description, product_name || ', ' || product_class || ', ' || coalesce(array_to_string(color, ', '), '') || ', ' || coalesce(array_to_string(style, ', '), '')
  || ', ' || coalesce(array_to_string(material, ', '), '') || ', ' || coalesce(array_to_string(countryoforigin, ', '), '')) AS product_description FROM normalized),
imputed AS (SELECT * EXCLUDE (average_rating, rating_count), coalesce(average_rating, (SELECT avg(average_rating) FROM filled)) AS average_rating,
  coalesce(rating_count, (SELECT median(rating_count) FROM filled)) AS rating_count FROM filled),
complete AS (SELECT * FROM imputed WHERE len(material) > 0 AND len(style) > 0 AND len(color) > 0 AND len(countryoforigin) > 0)"""

TRI = lambda u, lo, hi, mode: f"CASE WHEN {u} < {(mode - lo) / (hi - lo)!r}::double THEN {lo}::double + sqrt({u} * {(hi - lo) * (mode - lo)!r}::double) ELSE {hi}::double - sqrt((1.0::double - {u}) * {(hi - lo) * (hi - mode)!r}::double) END"
REPAIR = f""",
repaired AS (SELECT * EXCLUDE (average_rating, rating_count),
  CASE WHEN average_rating < 3.0 THEN {rounded(TRI(draw(SEED, 'rating', 'product_id'), 3.0, 5.0, 4.2), 1)} ELSE average_rating END AS average_rating,
  CASE WHEN rating_count < 100 THEN cast(floor({TRI(draw(SEED, 'rating_count', 'product_id'), 100.0, 10000.0, 1000.0)}) AS bigint) ELSE cast(trunc(rating_count) AS bigint) END AS rating_count
  FROM complete)"""

P = duck("p")
SHOW_LISTS = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in LISTS)


def raw(spark, sf):
    return view(spark, sf, "p")


def normalized(spark, sf):
    return cat.normalize_features(cat.filter_features(raw(spark, sf)), lookup_frame(spark))


def imputed(spark, sf):
    # Read three times below, so it is written out once.
    return cat.impute_mean_median(materialize(cat.fill_description(normalized(spark, sf))))


def repaired(spark, sf):
    return cat.repair_numeric(cat.filter_complete(imputed(spark, sf)), SEED)


@check("parse_features", f"WITH {P}, {PARSE} SELECT product_id, {SHOW_LISTS} FROM parsed")
def _(spark, sf):
    return cat.parse_features(raw(spark, sf)).select("product_id", *[joined(c) for c in LISTS])


@check("filter_features", f"WITH {P}, {PARSE} SELECT product_id, {SHOW_LISTS}, product_class, rating_count FROM filtered")
def _(spark, sf):
    return cat.filter_features(raw(spark, sf)).select("product_id", *[joined(c) for c in LISTS], "product_class", "rating_count")


@check("normalize_values", f"WITH {P}, {NORMALIZE} SELECT product_id, array_to_string(color, '|') AS color FROM normalized")
def _(spark, sf):
    return cat.normalize_values(cat.filter_features(raw(spark, sf)), lookup_frame(spark), {"color": "color"}, method="join").select("product_id", joined("color"))


@check("normalize_features", f"WITH {P}, {NORMALIZE} SELECT product_id, {SHOW_LISTS} FROM normalized")
def _(spark, sf):
    return normalized(spark, sf).select("product_id", *[joined(c) for c in LISTS])


@check("valid_values", f"""WITH {P}, {NORMALIZE}, valid AS (SELECT DISTINCT category, unnest(normalized) AS value FROM lookup)
 SELECT category, value, (SELECT count(*) FROM normalized n WHERE list_contains(CASE category WHEN 'material' THEN n.material WHEN 'style' THEN n.style WHEN 'color' THEN n.color ELSE n.countryoforigin END, value)) AS products FROM valid""")
def _(spark, sf):
    used = normalized(spark, sf).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("items")) for c in LISTS])).alias("pair")
    ).select("pair.category", F.explode("pair.items").alias("value")).groupBy("category", "value").agg(F.count("*").alias("products"))
    return cat.valid_values(lookup_frame(spark)).join(used, ["category", "value"], "left").fillna(0)


@check("fill_description", f"WITH {P}, {NORMALIZE} SELECT product_id, product_description FROM filled")
def _(spark, sf):
    return cat.fill_description(normalized(spark, sf)).select("product_id", "product_description")


@check("remap_class", f"""WITH {P}, {class_mapping_duck()} SELECT product_id, coalesce(m.product_class_fixed, p.product_class) AS product_class
 FROM p LEFT JOIN class_mapping m ON m.product_class = p.product_class""")
def _(spark, sf):
    return cat.remap_class(raw(spark, sf), class_mapping_frame(spark)).select("product_id", "product_class")


@check("impute_mean_median", f"WITH {P}, {NORMALIZE} SELECT product_id, {rounded('average_rating', 6)} AS average_rating, rating_count FROM imputed")
def _(spark, sf):
    return imputed(spark, sf).select("product_id", F.round("average_rating", 6).alias("average_rating"), "rating_count")


@check("repair_numeric", f"WITH {P}, {NORMALIZE}{REPAIR} SELECT product_id, {rounded('average_rating', 6)} AS average_rating, rating_count FROM repaired")
def _(spark, sf):
    return repaired(spark, sf).select("product_id", F.round("average_rating", 6).alias("average_rating"), "rating_count")


@check("filter_complete", f"WITH {P}, {NORMALIZE} SELECT product_id FROM complete")
def _(spark, sf):
    return cat.filter_complete(imputed(spark, sf)).select("product_id")


@check("drop_null_description", f"WITH {P}, {NORMALIZE} SELECT product_id, product_class FROM complete WHERE product_description IS NOT NULL")
def _(spark, sf):
    return cat.drop_null_description(cat.filter_complete(imputed(spark, sf))).select("product_id", "product_class")


@check("unique_categories", f"""WITH {duck('c')} SELECT DISTINCT category, {strip('v')} AS value FROM (
 SELECT 'color' AS category, unnest(color) AS v FROM c UNION ALL SELECT 'material', unnest(material) FROM c UNION ALL SELECT 'style', unnest(style) FROM c UNION ALL SELECT 'product_class', product_class FROM c) x
 WHERE {strip('v')} <> ''""")
def _(spark, sf):
    return cat.unique_categories(view(spark, sf, "c"))


SAMPLE = 150


@check("sample_n_sorted", f"WITH {P} SELECT product_id, product_name FROM p ORDER BY md5('{SEED}|' || product_id), product_id LIMIT {SAMPLE}")
def _(spark, sf):
    return cat.sample_n_sorted(raw(spark, sf), SAMPLE, SEED).select("product_id", "product_name")


@check("union_synthetic", f"WITH {P} SELECT product_id, product_name, rating_count FROM p UNION ALL SELECT 'synth_' || s_suppkey, s_name, NULL FROM supplier")
def _(spark, sf):
    synthetic = table(spark, sf, "supplier").select(F.concat(F.lit("synth_"), F.col("s_suppkey")).alias("product_id"), F.col("s_name").alias("product_name"))
    return cat.union_synthetic(raw(spark, sf), synthetic).select("product_id", "product_name", "rating_count")


@check("assign_dense_ids", f"WITH {P} SELECT 'product_' || row_number() OVER (ORDER BY product_name, p_partkey) AS product_id, p_partkey FROM p")
def _(spark, sf):
    return cat.assign_dense_ids(raw(spark, sf), ["product_name", "p_partkey"]).select("product_id", "p_partkey")


AUDIT = ["product_id", "product_class", "product_description", "product_features", "average_rating", "rating_count"]


@check("null_audit", f"WITH {P} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM p" for c in AUDIT))
def _(spark, sf):
    return cat.null_audit(raw(spark, sf).select(*AUDIT))


@check("clean_value", f"SELECT doc_id, {strip(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '[^a-zA-Z0-9]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM documents")
def _(spark, sf):
    return cat.clean_text_values(table(spark, sf, "documents"), "text").select("doc_id", "text")


@check("cast_float32", f"""WITH {duck('c')} SELECT product_id, cast(rating_count AS float) AS rating_count, cast(average_rating AS float) AS average_rating,
 cast(price AS float) AS price, product_name || ' ' || product_description AS product_description FROM c""")
def _(spark, sf):
    return cat.cast_float32(view(spark, sf, "c")).select("product_id", "rating_count", "average_rating", "price", "product_description")


def shown_list(c):
    return f"'{c}: [' || coalesce(array_to_string(list_transform({c}, lambda v: '''' || v || ''''), ', '), '') || ']'"


def shown(c, e):
    return f"'{c}: ' || coalesce({e}, 'None')"


JOIN_COLUMNS = ["product_description", "product_class", "material", "style", "color", "rating_count", "average_rating", "price"]
STRINGIFY = " || ', ' || ".join(
    shown_list(c) if c in LISTS else shown(c, f"cast({c} AS varchar)") for c in JOIN_COLUMNS
)


@check("stringify_row", f"WITH {duck('c')} SELECT product_id, {STRINGIFY} AS product_info FROM c")
def _(spark, sf):
    return cat.stringify_row(view(spark, sf, "c"), JOIN_COLUMNS, "product_info").select("product_id", "product_info")


@check("dedupe_latest", "SELECT cast(l_partkey AS varchar) AS product_id, arg_max(l_quantity, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity) AS quantity, max(l_orderkey * 100000 + l_linenumber * 1000 + l_quantity) AS seq FROM lineitem GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").alias("quantity"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq"),
    )
    return cat.dedupe_latest(rows, "product_id", "seq").select("product_id", "quantity", "seq")


@check("predict_class", f"WITH {P} SELECT product_id, product_class AS given, product_class IS NULL AS filled, true AS valid FROM p")
def _(spark, sf):
    """What is determined of the forest's answers: known classes stay, and every gap gets a class that occurs."""
    given = materialize(raw(spark, sf).select("product_id", "product_name", "product_description", "product_class"))
    predicted = cat.predict_class(given).select("product_id", F.col("product_class").alias("now"))
    classes = given.agg(F.collect_set("product_class")).scalar()
    both = predicted.join(given.select("product_id", F.col("product_class").alias("given")), "product_id")
    valid = F.when(F.col("given").isNull(), F.array_contains(classes, F.col("now"))).otherwise(F.col("now") == F.col("given"))
    return both.select("product_id", "given", F.col("given").isNull().alias("filled"), F.coalesce(valid, F.lit(False)).alias("valid"))
