"""Boosts by catalogue quantiles and query preferences."""

from pyspark.sql import DataFrame, functions as F

from shelfrank.functions.ranking import quantiles, stack_columns, top_k

STAT_COLUMNS = ("price", "average_rating", "rating_count")
POINTS = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
BOOST_LIMIT = 0.9
# Weight parameter, product field, sign of the weight the rule is for,
# comparison, quantile, factor. A boost is factor x weight, for price factor x |weight|.
BOOST_RULES = (
    ("price_weight", "price", -1, "<=", "p25", 0.6),
    ("price_weight", "price", -1, "<=", "p50", 0.3),
    ("price_weight", "price", 1, ">=", "p75", 0.3),
    ("price_weight", "price", 1, ">=", "p90", 0.5),
    ("rating_weight", "average_rating", 1, ">=", "p90", 0.5),
    ("rating_weight", "average_rating", 1, ">=", "p75", 0.3),
    ("rating_weight", "average_rating", -1, "<=", "p25", 0.3),
    ("rating_count_weight", "rating_count", 1, ">=", "p90", 0.4),
    ("rating_count_weight", "rating_count", 1, ">=", "p75", 0.2),
    ("rating_count_weight", "rating_count", -1, "<=", "p25", 0.3),
)


def floor_quantiles(products: DataFrame, columns=STAT_COLUMNS) -> DataFrame:
    """(name, label, value): the value at the floor of q x (n - 1), no mixing of neighbours."""
    return quantiles(stack_columns(products, columns), POINTS, False)


def boost_rules(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Rules of every query: (query_id, field, op, bound, boost).

    A negative weight on price prefers cheap products; on rating and rating count it
    gives a negative boost to low values. Bounds on rating counts lose their fraction.
    """
    candidates = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(label).alias("label"),
                F.when(
                    F.col(param) * sign > 0,
                    F.greatest(
                        F.lit(-BOOST_LIMIT),
                        F.least(F.lit(BOOST_LIMIT), F.lit(factor) * (F.abs(param) if field == "price" else F.col(param))),
                    ),
                ).alias("boost"),
            )
            for param, field, sign, op, label, factor in BOOST_RULES
        ]
    )
    asked = queries.select("query_id", F.explode(F.filter(candidates, lambda r: r.boost.isNotNull())).alias("r")).select("query_id", "r.*")
    bound = F.when(F.col("field") == "rating_count", F.col("value").cast("long").cast("double")).otherwise(F.col("value"))
    return asked.join(stats.withColumnRenamed("name", "field"), ["field", "label"]).select("query_id", "field", "op", bound.alias("bound"), "boost")


def boost_apply(hits: DataFrame, rules: DataFrame, products: DataFrame, k: int = 20) -> DataFrame:
    """Hits rescored as score x (1 + sum of the boosts that hold), ranked again and cut to k.

    A query has at most a handful of rules, so they meet its hits as one short array.
    """
    per_query = rules.groupBy("query_id").agg(F.collect_list(F.struct("field", "op", "bound", "boost")).alias("rules"))
    fields = sorted({r[1] for r in BOOST_RULES})

    def boost_of(rule):
        value = F.lit(None).cast("double")
        for f in fields:
            value = F.when(rule.field == f, F.col(f).cast("double")).otherwise(value)
        holds = F.when(rule.op == "<=", value <= rule.bound).otherwise(value >= rule.bound)
        return F.when(F.coalesce(holds, F.lit(False)), rule.boost).otherwise(F.lit(0.0))

    total = F.coalesce(F.aggregate("rules", F.lit(0.0), lambda s, r: s + boost_of(r)), F.lit(0.0))
    boosted = (
        hits.select("query_id", "product_id", "score")
        .join(products.select("product_id", *fields), "product_id")
        .join(per_query, "query_id", "left")
        .withColumn("boost", total)
        .withColumn("boosted", F.round(F.col("score") * (1 + F.col("boost")), 9))
    )
    return top_k(boosted, ["query_id"], [F.desc("boosted"), "product_id"], k).select(
        "query_id", "product_id", "score", "boost", "boosted", "position"
    )
