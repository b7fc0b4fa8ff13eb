"""Fixture views derived from the given tables, written once for Spark and for DuckDB.

The catalogue, query and ranking shapes the jobs need do not exist among the given
tables, so they are derived here from whole tables. Everything below is input only:
what the jobs compute on it is written twice, as DataFrame jobs and as plain SQL.
"""

import re

from pyspark.sql import DataFrame, SparkSession

# Small lookup rows; raw -> normalized, "|" separates several targets.
MATERIALS = ["Solid Wood", " steel", "Leather", "glass", "Particle Board"]
STYLES = ["Modern", "RUSTIC", "Glam", "Old World"]
COUNTRIES = ["China", "Made in USA", "Italy"]
NORMALIZATION = {
    "material": {"solid wood": "wood", "steel": "metal", "glass": "glass", "particle board": "wood|laminate"},
    "style": {"modern": "modern", "rustic": "rustic", "glam": "glam"},
    "color": {"red": "red", "blue": "blue", "hot": "red", "cold": "blue|white", "old": "brown", "new": "white|black"},
    "countryoforigin": {"china": "China", "made in usa": "USA", "italy": "Italy"},
}
CLASS_MAPPING = {"PROMO": "SPECIAL", "SMALL": "COMPACT"}
PRICE_RANGES = {"STANDARD": (40.0, 160.0), "MEDIUM": (120.0, 620.0), "LARGE": (300.0, 2400.0), "ECONOMY": (5.0, 60.0), "SPECIAL": (10.0, 90.0)}
WEIGHT_TIERS = [
    ("material", 1.3, ["glass", "metal"]), ("material", 1.05, ["wood"]), ("material", 0.8, ["laminate"]),
    ("style", 1.2, ["glam"]), ("style", 1.15, ["modern"]), ("style", 0.95, ["rustic"]),
    ("countryoforigin", 1.2, ["Italy", "USA"]), ("countryoforigin", 0.9, ["China"]),
]
RATING_THRESHOLDS = [("top", 4.4, 5.0, 1.25), ("fine", 3.6, 4.4, 1.1), ("plain", 2.8, 3.6, 1.0), ("low", 1.0, 2.8, 0.85)]
SYSTEMS = [f"{kind}-{mode}" for kind in ("boosted", "fielded", "weighted") for mode in ("extracted", "given", "text")] + ["hybrid"]


def _word(expr, words):
    cases = " ".join(f"WHEN {expr} = {i} THEN '{w}'" for i, w in enumerate(words[:-1]))
    return f"CASE {cases} ELSE '{words[-1]}' END"


def _array(dialect, *items):
    inner = ", ".join(items)
    return f"array({inner})" if dialect == "spark" else f"[{inner}]"


def _empty(dialect):
    return "cast(array() AS array<string>)" if dialect == "spark" else "cast([] AS varchar[])"


def raw_products(d):
    """P: raw catalogue with a feature string, nulls and repeated feature keys."""
    return f"""
SELECT 'product_' || cast(p_partkey AS string) AS product_id,
  p_partkey, p_name AS product_name,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS product_class,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE t.text END AS product_description,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE
    'Primary Material : ' || {_word('p_size % 5', MATERIALS)} || '|Color:' || split_part(p_name, ' ', 1)
    || '|novalue'
    || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '|Style : ' || {_word('p_partkey % 4', STYLES)} END
    || '|Country of Origin: ' || {_word('p_partkey % 3', COUNTRIES)}
    || CASE WHEN p_partkey % 7 = 0 THEN '|Color: Blue :x' ELSE '' END
    || CASE WHEN p_partkey % 5 = 0 THEN '|Top COLOR:white ' ELSE '' END
    || CASE WHEN p_partkey % 9 = 0 THEN '|Material Color: RED' ELSE '' END
  END AS product_features,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE cast(10 + sum_qty % 41 AS double) / 10 END AS average_rating,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE cast((sum_qty * 7) % 3000 AS double) END AS rating_count
FROM part
LEFT JOIN (SELECT l_partkey, cast(sum(l_quantity) AS bigint) AS sum_qty FROM lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey
LEFT JOIN documents t ON t.doc_id = p_partkey"""


def products(d):
    """C: clean catalogue with list attributes and a price."""
    arr, empty = _array, _empty(d)
    return f"""
SELECT 'product_' || cast(p_partkey AS string) AS product_id, p_partkey,
  p_name AS product_name, p_type AS product_class,
  coalesce(t.text, p_name || ' in ' || lower(p_type)) AS product_description,
  CASE WHEN p_partkey % 29 = 0 THEN {empty} WHEN p_partkey % 6 = 0 THEN {arr(d, "'wood'", "'metal'")} ELSE {arr(d, _word('p_size % 5', ['wood', 'metal', 'glass', 'laminate', 'unknown']))} END AS material,
  {arr(d, _word('p_partkey % 4', ['modern', 'rustic', 'glam', 'Old World']))} AS style,
  CASE WHEN p_partkey % 5 = 0 THEN {arr(d, "split_part(p_name, ' ', 1)", "'white 20 %'")} ELSE {arr(d, "split_part(p_name, ' ', 1)")} END AS color,
  {arr(d, _word('p_partkey % 3', ['China', 'USA', 'Italy']))} AS countryoforigin,
  cast(coalesce(sum_qty, 0) * 7 % 3000 AS bigint) AS rating_count,
  CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE cast(10 + coalesce(sum_qty, 0) % 41 AS double) / 10 END AS average_rating,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE cast((p_partkey * 37) % 1180 * 5 + 5 AS double) END AS price
FROM part
LEFT JOIN (SELECT l_partkey, cast(sum(l_quantity) AS bigint) AS sum_qty FROM lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey
LEFT JOIN documents t ON t.doc_id = p_partkey"""


def search_queries(d):
    """Q: one query per (class, name) pair of the whole part table, with every parameter in use.

    The pairs are a vocabulary: their number does not grow with the rows.
    """
    arr, empty = _array, _empty(d)
    nul = f"cast(NULL AS {'array<string>' if d == 'spark' else 'varchar[]'})"
    kind = "CASE idx % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'negation' WHEN 2 THEN 'number' ELSE 'complex' END"
    return f"""
SELECT {kind} || '-' || CASE WHEN idx < 10 THEN '00' WHEN idx < 100 THEN '0' ELSE '' END || cast(idx AS string) AS query_id,
  {kind} AS query_type, idx,
  lower(p_name || ' ' || p_type) || CASE WHEN idx % 5 = 0 THEN ' of the thth' ELSE '' END AS query_text,
  CASE WHEN idx % 9 = 0 THEN NULL ELSE p_type END AS product_class,
  CASE WHEN idx % 7 = 0 THEN {arr(d, "split_part(p_name, ' ', 1)", "'red'")} WHEN idx % 3 = 0 THEN {empty} WHEN idx % 11 = 5 THEN {nul} ELSE {arr(d, "split_part(p_name, ' ', 1)")} END AS color,
  CASE WHEN idx % 13 = 0 THEN {arr(d, "'wood'")} ELSE {nul} END AS material,
  CASE WHEN idx % 6 = 1 THEN {arr(d, "'modern'")} ELSE {nul} END AS style,
  CASE WHEN idx % 10 = 4 THEN {arr(d, "'white 20 %'")} ELSE {nul} END AS color_negated,
  CASE WHEN idx % 4 = 1 THEN {arr(d, "'wood'", "'glass'")} ELSE {nul} END AS material_negated,
  CASE WHEN idx % 8 = 5 THEN {arr(d, "'rustic'")} ELSE {nul} END AS style_negated,
  CASE WHEN idx % 4 = 2 THEN cast(2 + idx % 3 AS double) WHEN idx % 4 = 3 THEN cast(0 AS double) END AS rating_min,
  CASE WHEN idx % 12 = 2 THEN cast(500 AS double) WHEN idx % 12 = 6 THEN cast(0 AS double) END AS rating_count_min,
  CASE WHEN idx % 6 = 2 THEN cast(1000 + 10 * idx AS double) WHEN idx % 6 = 4 THEN cast(0 AS double) END AS price_max,
  CASE WHEN idx % 4 = 3 THEN cast(idx % 3 - 1 AS double) END AS rating_weight,
  CASE WHEN idx % 8 = 3 THEN cast(1 - idx % 5 AS double) / 2 END AS rating_count_weight,
  CASE WHEN idx % 4 = 3 THEN cast(idx % 5 - 2 AS double) END AS price_weight
FROM (SELECT p_type, p_name, cast(row_number() OVER (ORDER BY p_type, p_name) AS bigint) AS idx
      FROM part GROUP BY p_type, p_name) g"""


def _ranking_lines(chosen="true"):
    """Every order line under a query of its part; lines that are not ``chosen`` are under another one, by their return flag."""
    return f"""
SELECT CASE l_partkey % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'negation' WHEN 2 THEN 'number' WHEN 3 THEN 'complex' ELSE 'synth' END
  || '-' || cast(l_partkey AS string) || CASE WHEN {chosen} THEN '' ELSE '-' || l_returnflag END AS query_id,
  l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate
FROM lineitem"""


def truth_rankings(d):
    """R, truth: all lines, best quantity first; suppliers repeat. Returned lines with a high discount are the part's plain query, which some parts lack."""
    lines = _ranking_lines("l_returnflag = 'R' AND l_discount >= 0.08")
    if d == "spark":
        # Names of documents are made after the lines have moved.
        return f"""
SELECT query_id, 'supp_' || cast(l_suppkey AS string) AS product_id, rank FROM (SELECT query_id, l_suppkey,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS int) AS rank
FROM ({lines}) x) y"""
    return f"""
SELECT query_id, 'supp_' || cast(l_suppkey AS string) AS product_id,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS int) AS rank
FROM ({lines}) x"""


DEALT = "/*+ REPARTITION(:parts, query_id) */"


def system_rankings(d):
    """R, predictions: one result table per system, each with another order of a query's suppliers.

    Some queries have no truth and some no prediction. Ranks follow the score directly: they
    have gaps and ties.
    """
    lines = _ranking_lines("l_returnflag <> 'A'")
    kind = "CASE WHEN l_partkey % 6 = 1 THEN NULL WHEN l_linenumber = 7 THEN 'mixed' ELSE split_part(query_id, '-', 1) END"
    if d == "spark":
        # Here the lines may be dealt out by query before there are ten rows of each, with no more columns than needed.
        lines, kind = f"SELECT {DEALT} query_id, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, {kind} AS query_type FROM ({lines}) l", "query_type"
    keys = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_discount * l_tax", "-l_quantity", "-l_extendedprice", "-l_discount", "-l_tax", "l_quantity * l_tax"]
    if d == "spark":
        scores = "explode(array(" + ", ".join(f"named_struct('system', '{s}', 'score', cast({k} AS double))" for s, k in zip(SYSTEMS, keys)) + "))"
    else:
        scores = "unnest([" + ", ".join(f"{{'system': '{s}', 'score': cast({k} AS double)}}" for s, k in zip(SYSTEMS, keys)) + "])"
    return f"""
SELECT one.system AS system, query_id, 'supp_' || cast(l_suppkey AS string) AS product_id,
  cast(100000000 - round(one.score * 100) AS int) AS rank,
  {kind} AS query_type
FROM (SELECT *, {scores} AS one FROM ({lines}) x) y"""


def one_system(d):
    """R, predictions of one system by price, over all lines; well discounted ones are the part's plain query."""
    lines = _ranking_lines("l_returnflag <> 'A' AND l_discount >= 0.07")
    return f"""
SELECT query_id, 'supp_' || cast(l_suppkey AS string) AS product_id,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS int) AS rank,
  CASE WHEN l_partkey % 6 = 1 THEN NULL WHEN l_linenumber = 7 THEN 'mixed' ELSE split_part(query_id, '-', 1) END AS query_type
FROM ({lines}) x"""


def result_map(d):
    """R, one result list per query, over all lines; every query of the truth keeps a row, some lists are empty."""
    collect = "transform(array_sort(collect_list(struct(rank, product_id))), x -> x.product_id)" if d == "spark" else "list(product_id ORDER BY rank)"
    empty = _empty(d)
    return f"""
SELECT q.query_id, coalesce(r.product_ids, {empty}) AS product_ids
FROM (SELECT query_id FROM ({truth_rankings(d)}) z UNION SELECT query_id FROM ({one_system(d)}) o) q
LEFT JOIN (SELECT query_id, {collect} AS product_ids FROM ({one_system(d)}) o GROUP BY query_id) r ON r.query_id = q.query_id"""


def responses(d):
    """J: model answers of several shapes made from the whole event table."""
    fence = "'```json' || chr(10) || body || chr(10) || '```'"
    return f"""
SELECT 'q-' || cast(event_id AS string) AS key, event_type,
  CASE event_id % 8 WHEN 0 THEN body WHEN 1 THEN {fence} WHEN 2 THEN '  ' || body || '  ' WHEN 3 THEN '[' || body || ']'
    WHEN 4 THEN substring(body, 1, 9) WHEN 5 THEN '' WHEN 6 THEN '```' || chr(10) || body || '```' ELSE '{{"price_max": ' || cast(user_id AS string) || ', "color": "red"}}' END AS response_text
FROM (SELECT *, '{{"color": "' || event_type || '", "material": ["wood", "' || event_type || '"], "price_max": ' || cast(user_id AS string) ||
   ', "USAGE_CONTEXTS": ["office", "' || event_type || '"], "SIZE_DESCRIPTORS": "small", "BENEFIT_PHRASES": ["easy to ' || event_type || '"]}}' AS body FROM events) e"""


VIEWS = {
    "p": raw_products,
    "c": products,
    "q": search_queries,
    "truth": truth_rankings,
    "systems": system_rankings,
    "one_system": one_system,
    "result_map": result_map,
    "responses": responses,
}

TABLES = ["part", "lineitem", "documents", "events", "embeddings", "benchmark", "orders", "customer", "supplier"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A fixture as a DataFrame; given tables are read straight from their files. ``dealt`` deals the systems' lines out by query before they multiply."""
    text = VIEWS[name]("spark").replace(DEALT, DEALT.replace(":parts", spark.conf.get("spark.sql.shuffle.partitions")) if dealt else "")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    ctes = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"WITH {ctes} {text}")


def duck(*names: str) -> str:
    """The same fixtures as leading DuckDB common table expressions."""
    return ", ".join(f"{n} AS ({VIEWS[n]('duckdb')})" for n in names)


def lookup_frame(spark: SparkSession) -> DataFrame:
    rows = [(c, i, raw, n.split("|")) for c, m in NORMALIZATION.items() for i, (raw, n) in enumerate(m.items())]
    return spark.createDataFrame(rows, "category string, seq int, raw string, normalized array<string>")


def lookup_duck() -> str:
    rows = ", ".join(
        f"('{c}', {i}, '{raw}', [{', '.join(repr(x) for x in n.split('|'))}])"
        for c, m in NORMALIZATION.items() for i, (raw, n) in enumerate(m.items())
    )
    return f"lookup AS (SELECT * FROM (VALUES {rows}) v(category, seq, raw, normalized))"


def weights_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i.lower(), w) for t, w, items in WEIGHT_TIERS for i in items], "feature_type string, item string, weight double")


def weights_duck() -> str:
    rows = ", ".join(f"('{t}', '{i.lower()}', cast({w} AS double))" for t, w, items in WEIGHT_TIERS for i in items)
    return f"weights AS (SELECT * FROM (VALUES {rows}) v(feature_type, item, weight))"


def thresholds_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(RATING_THRESHOLDS)], "seq int, name string, low double, high double, multiplier double")


def thresholds_duck() -> str:
    rows = ", ".join(f"({i}, '{n}', cast({a} AS double), cast({b} AS double), cast({m} AS double))" for i, (n, a, b, m) in enumerate(RATING_THRESHOLDS))
    return f"thresholds AS (SELECT * FROM (VALUES {rows}) v(seq, name, low, high, multiplier))"


def ranges_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, a, b) for c, (a, b) in PRICE_RANGES.items()], "product_class string, price_min double, price_max double")


def ranges_duck() -> str:
    rows = ", ".join(f"('{c}', cast({a} AS double), cast({b} AS double))" for c, (a, b) in PRICE_RANGES.items())
    return f"ranges AS (SELECT * FROM (VALUES {rows}) v(product_class, price_min, price_max))"


def class_mapping_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASS_MAPPING.items()), "product_class string, product_class_fixed string")


def class_mapping_duck() -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in CLASS_MAPPING.items())
    return f"class_mapping AS (SELECT * FROM (VALUES {rows}) v(product_class, product_class_fixed))"
