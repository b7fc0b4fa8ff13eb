"""Per-query attribute and range conditions."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.functions.lookup import small_side
from shelfrank.functions.text import strip

LIST_ATTRIBUTES = ("color", "material", "style")
LIST_PARAMS = LIST_ATTRIBUTES + tuple(f"{a}_negated" for a in LIST_ATTRIBUTES)
# (product column, parameter, True when the product value must not exceed the parameter)
RANGES = (("price", "price_max", True), ("average_rating", "rating_min", False), ("rating_count", "rating_count_min", False))
RANGE_PARAMS = tuple(r[1] for r in RANGES)
# Keys the products are dealt over for queries without a wanted attribute.
SPREAD = 64
ABSENT_RULES = ("positive", "truthy", "null_only")


def prepare_params(queries: DataFrame, absent: str = "positive") -> DataFrame:
    """Null out the parameters that set no condition.

    Lists lose blank and repeated entries; an empty list is no condition. Numbers are no condition
    when null and, depending on the rule, when not above zero (``positive``) or when
    zero (``truthy``). Parameter columns the table lacks are added as null.
    """
    if absent not in ABSENT_RULES:
        raise ValueError(f"absent must be one of {ABSENT_RULES}")
    out = {}
    for name in LIST_PARAMS:
        if name not in queries.columns:
            out[name] = F.lit(None).cast("array<string>")
            continue
        values = F.col(name) if queries.schema[name].dataType.typeName() == "array" else F.array(name)
        kept = F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))
        out[name] = F.when(F.size(kept) > 0, kept)
    for name in RANGE_PARAMS:
        if name not in queries.columns:
            out[name] = F.lit(None).cast("double")
            continue
        value = F.col(name).cast("double")
        given = {"positive": value > 0, "truthy": value != 0, "null_only": F.lit(True)}[absent]
        out[name] = F.when(given, value)
    if "product_class" not in queries.columns:
        out["product_class"] = F.lit(None).cast("string")
    return queries.withColumns(out)


def match_condition(product, query, class_text: bool = False) -> Column:
    """All conditions of a prepared query on a product; both arguments map a name to a column."""
    keep = F.lit(True)
    any_condition = F.lit(False)
    # The cheap comparisons come first.
    for column, param, upper in RANGES:
        bound = query(param)
        inside = product(column) <= bound if upper else product(column) >= bound
        keep &= bound.isNull() | F.coalesce(inside, F.lit(False))
        any_condition |= bound.isNotNull()
    for attribute in LIST_ATTRIBUTES:
        wanted, unwanted = query(attribute), query(f"{attribute}_negated")
        keep &= wanted.isNull() | F.coalesce(F.arrays_overlap(product(attribute), wanted), F.lit(False))
        keep &= unwanted.isNull() | ~F.coalesce(F.arrays_overlap(product(attribute), unwanted), F.lit(False))
        any_condition |= wanted.isNotNull() | unwanted.isNotNull()
    if class_text:
        # The class only narrows a search that has some other condition.
        named = F.contains(F.lower(product("product_class")), F.lower(query("product_class")))
        blank = query("product_class").isNull() | (query("product_class") == "")
        keep &= ~any_condition | blank | F.coalesce(named, F.lit(False))
    return keep


def tagged(column: Column, attribute: str) -> Column:
    return F.coalesce(F.transform(column, lambda v: F.concat(F.lit(f"{attribute}="), v)), F.array().cast("array<string>"))


def param_filter(products: DataFrame, queries: DataFrame, absent: str = "positive", class_text: bool = False) -> DataFrame:
    """Matching (query_id, product_id) pairs.

    Products meet queries by an equi-join on one attribute value the query asks for;
    the other conditions ride on that join, so only matching pairs leave it. Queries
    that ask for no attribute have all products to look at: products are dealt over
    ``SPREAD`` keys by their id, and such a query stands under each of them. A query table of
    checked size goes to the products, which then are not shuffled; with a larger one
    the join shuffles on the value and the optimizer splits the frequent ones.
    """
    q = prepare_params(queries, absent)
    wanted = F.lit(None).cast("array<string>")
    for attribute in reversed(LIST_ATTRIBUTES):
        wanted = F.when(F.col(attribute).isNotNull(), tagged(F.col(attribute), attribute)).otherwise(wanted)
    spread = F.array(*[F.lit(f"any#{i}") for i in range(SPREAD)])
    params = [*LIST_PARAMS, *RANGE_PARAMS, "product_class"]
    left = (
        q.withColumn("wanted", wanted)
        .select("query_id", F.struct(*params, "wanted").alias("q"), F.explode(F.coalesce("wanted", spread)).alias("anchor"))
    )
    own = F.concat(F.lit("any#"), F.pmod(F.xxhash64("product_id"), F.lit(SPREAD)))
    right = (
        products.withColumn("tags", F.array_distinct(F.concat(*[tagged(F.col(a), a) for a in LIST_ATTRIBUTES])))
        .select("product_id", F.struct(*LIST_ATTRIBUTES, *[r[0] for r in RANGES], "product_class", "tags").alias("p"), F.explode(F.array_append("tags", own)).alias("anchor"))
    )
    # A product may hold several of the wanted values: only the first of them counts.
    first = F.col("q.wanted").isNull() | (F.size("q.wanted") == 1) | (F.get(F.array_intersect(F.col("q.wanted"), F.col("p.tags")), F.lit(0)) == F.col("anchor"))
    matches = match_condition(lambda n: F.col(f"p.{n}"), lambda n: F.col(f"q.{n}"), class_text)
    return right.join(small_side(left), "anchor").filter(matches & first).select("query_id", "product_id")
