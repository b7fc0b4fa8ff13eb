"""Batch retrieval: score fusion, hybrid search, weighted multi-attribute search, result lists."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.functions.ranking import top_k
from shelfrank.operators.filters import LIST_ATTRIBUTES, LIST_PARAMS, RANGE_PARAMS, RANGES
from shelfrank.operators.textsearch import product_text, query_text_expand, sparse_topk
from shelfrank.operators.vectors import SCORE_DIGITS, dense_topk, unit, vector_topk

DEFAULT_TOP_K = 20
OVERFETCH = 6
# Upper ends of the number spaces and which of them are logarithmic.
NUMBER_SPACES = {"rating_count": (8000.0, True), "average_rating": (5.0, False), "price": (5900.0, True)}
PAYLOAD = ("product_name", "product_description", "color", "product_class", "material", "style", "price", "average_rating", "rating_count")
PARAM_NAMES = ("product_class", "product_description", *LIST_PARAMS, *RANGE_PARAMS, "rating_weight", "rating_count_weight", "price_weight")
# The parameter names the weighted search accepts.
SEARCH_PARAM_NAMES = (
    "description_space_weight", "class_space_weight", "price_weight", "rating_count_weight", "rating_weight",
    "product_description", "description_similar_weight", "product_class", "class_similar_weight",
    "price_max", "rating_min", "rating_count_min", "material", "color", "style",
    "material_negated", "color_negated", "style_negated", "natural_query",
)


def dbsf_fusion(lists: DataFrame, k: int) -> DataFrame:
    """Fuse scored lists (query_id, source, product_id, score) and keep the k best.

    In each list a score becomes its place between three deviations below and above
    the list's mean; 0.5 when the list has one entry or no spread. Places add up over
    lists. Lists are already cut, so the windows below are small.
    """
    w = Window.partitionBy("query_id", "source")
    spread = F.stddev_samp("score").over(w)
    mean = F.avg("score").over(w)
    flat = spread.isNull() | (F.max("score").over(w) == F.min("score").over(w))
    placed = lists.withColumn(
        "place", F.when(flat, F.lit(0.5)).otherwise((F.col("score") - (mean - 3 * spread)) / (6 * spread))
    )
    fused = placed.groupBy("query_id", "product_id").agg(F.round(F.sum("place"), SCORE_DIGITS).alias("score"))
    return top_k(fused, ["query_id"], [F.desc("score"), "product_id"], k)


def candidate_lists(products: DataFrame, queries: DataFrame, limit: int, text: str = "query_text", absent: str = "positive") -> DataFrame:
    """Dense and sparse candidates under the query conditions, ``limit`` of each per query.

    ``products`` carries vector, attributes and the text fields, ``queries`` vector, text
    and parameters.
    """
    expanded = query_text_expand(queries, text, "_search_text")
    dense = dense_topk(products, queries, limit, True, absent).select("query_id", F.lit("dense").alias("source"), "product_id", "score")
    sparse = sparse_topk(product_text(products, "text"), expanded, limit, "_search_text", products, absent).select(
        "query_id", F.lit("sparse").alias("source"), "product_id", "score"
    )
    return dense.unionByName(sparse)


def with_payload(hits: DataFrame, products: DataFrame, columns=PAYLOAD) -> DataFrame:
    """Product columns for the few rows that made the list."""
    return hits.join(products.select("product_id", *columns), "product_id")


def hybrid_search(products: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, text: str = "query_text", absent: str = "positive") -> DataFrame:
    """Both candidate lists, over-fetched and fused: (query_id, product_id, score, position)."""
    return dbsf_fusion(candidate_lists(products, queries, k * OVERFETCH, text, absent), k)


# ---------------------------------------------------------------- weighted search


def numeric_score(value: Column, top: float, logarithmic: bool) -> Column:
    """Share of ``top`` in [0, 1], on a linear or logarithmic scale; null stays null."""
    clamped = F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(float(top)))
    scaled = F.log1p(clamped) / F.log1p(F.lit(float(top))) if logarithmic else clamped / top
    return F.when(value.isNotNull(), scaled)


def multi_attribute_search(products: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, absent: str = "positive") -> DataFrame:
    """Weighted sum of description, class, rating count, rating and price similarity under hard filters.

    Description and numbers are laid side by side in one vector and their weights go into
    the query vector, so the exact search is the one over vectors; an equal class adds its
    weight. Weights may be negative; description and class count 1 and the numbers 0 where
    a query sets no weight.
    """

    def weight(name, default):
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in queries.columns else F.lit(default)

    spaces = ("rating_count", "average_rating", "price")
    numbers = F.array(*[F.coalesce(numeric_score(F.col(c), *NUMBER_SPACES[c]), F.lit(0.0)) for c in spaces])
    lowered = F.nullif(F.lower("product_class"), F.lit(""))
    docs = products.withColumn("vector", F.concat(unit(F.col("vector")), numbers)).withColumn("product_class", lowered)
    w_numbers = F.array(*[weight(w, 0.0) for w in ("rating_count_weight", "rating_weight", "price_weight")])
    asked = (
        queries.withColumn("_w", weight("description_space_weight", 1.0) * weight("description_similar_weight", 1.0))
        .withColumn("_unit", unit(F.col("vector")))
        .withColumn("vector", F.concat(F.transform("_unit", lambda x: x * F.col("_w")), w_numbers))
        .withColumn("class_weight", weight("class_space_weight", 1.0) * weight("class_similar_weight", 1.0))
        .withColumn("product_class", lowered)
    )
    return vector_topk(docs, asked, k, "dot", True, absent)


# ---------------------------------------------------------------- query sets


def query_mode(queries: DataFrame, mode: str, extracted: DataFrame | None = None) -> DataFrame:
    """Choose the parameters a run uses: ``none`` empties them, ``gt`` keeps the given ones, ``nlq`` takes extracted ones."""
    names = [n for n in PARAM_NAMES if n in queries.columns]
    if mode == "gt":
        return queries
    if mode == "none":
        return queries.withColumns({n: F.lit(None).cast(queries.schema[n].dataType) for n in names})
    if mode != "nlq":
        raise ValueError("mode must be 'none', 'gt' or 'nlq'")
    have = [n for n in names if n in extracted.columns]
    lost = [F.lit(None).cast(queries.schema[n].dataType).alias(n) for n in names if n not in have]
    kept = [c for c in queries.columns if c not in names]
    return queries.select(*kept, *lost).join(extracted.select("query_id", *have), "query_id", "left").select(*queries.columns)


def params_map(queries: DataFrame, names=PARAM_NAMES) -> DataFrame:
    """(query_id, params) with one text per parameter that is set."""
    entries = []
    for n in [n for n in names if n in queries.columns]:
        is_list = queries.schema[n].dataType.typeName() == "array"
        value = F.array_join(n, "|") if is_list else F.col(n).cast("string")
        entries.append(F.struct(F.lit(n).alias("k"), value.alias("v")))
    given = F.filter(F.array(*entries), lambda e: e.v.isNotNull())
    return queries.select("query_id", F.map_from_entries(given).alias("params"))


def restrict_params(df: DataFrame, allowed=SEARCH_PARAM_NAMES, column: str = "params") -> DataFrame:
    """Keep allowed names of a parameter map; the natural-language text never reaches the search."""
    names = [n for n in allowed if n != "natural_query"]
    return df.withColumn(column, F.map_filter(column, lambda k, v: k.isin(names)))


def resume_missing(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries whose id has no stored parameters yet."""
    return queries.join(done.select("query_id"), "query_id", "left_anti")


def result_lists(queries: DataFrame, hits: DataFrame, order: str = "position") -> DataFrame:
    """(query_id, product_ids) for every query; null ids are dropped, no hits give an empty list."""
    collected = (
        hits.filter(F.col("product_id").isNotNull())
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "product_id"))), lambda h: h.product_id).alias("product_ids"))
    )
    return queries.select("query_id").join(collected, "query_id", "left").withColumn(
        "product_ids", F.coalesce("product_ids", F.array().cast("array<string>"))
    )
