"""Query conditions on bitmaps: one row of the index stands for 64 products.

Products get dense numbers; a word of 64 of them is one row with a bit map (a long) per attribute value, and
for each number column its values in order, each with the products up to that value (range-encoded
bitmaps). A query's conditions are OR, AND and AND NOT of these longs, so conditions are
evaluated once per (query, word) and products appear only where a bit is left.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.functions.lookup import bind, small_side
from shelfrank.operators.catalog import assign_dense_ids
from shelfrank.operators.filters import LIST_ATTRIBUTES, RANGES, prepare_params, tagged
from shelfrank.session import materialize

BITS = 64
# Words a task meets a query without a wanted value in.
SLICE = 4096


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def bitmap_index(products: DataFrame, order=("product_class", "product_id")) -> DataFrame:
    """One row per word: (word, bits, ids, tags, classes, and an array of (value, upto) per number column).

    Products next to each other in ``order`` share words, so values that go with it are in few of them. Every
    product is in the index once per row of the table. The rows move twice, for the numbers and for the words; all parts
    of a word are made inside one partitioning.
    """
    dense = assign_dense_ids(products.withColumn("_id", F.col("product_id")), list(order), prefix="", column="_number")
    number = F.col("_number").cast("bigint") - 1
    columns = [*LIST_ATTRIBUTES, *[r[0] for r in RANGES], "product_class"]
    placed = dense.select(F.floor(number / BITS).alias("word"), (number % BITS).cast("int").alias("place"), F.col("_id").alias("product_id"), *columns)
    # The number is given, as words are few and narrow but queries grow them: merged partitions would leave too few tasks.
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(parts, "word").withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place")))

    def by_value(entries: Column, name: str) -> DataFrame:
        """word -> map of each distinct entry to its products."""
        bits = placed.select("word", "bit", F.explode(entries).alias("entry")).filter("entry IS NOT NULL").groupBy("word", "entry").agg(F.bit_or("bit").alias("bits"))
        # At most 64 products' entries.
        return bits.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("entry", "bits"))).alias(name))

    tags = by_value(F.array_distinct(F.concat(*[tagged(F.col(a), a) for a in LIST_ATTRIBUTES])), "tags")
    classes = by_value(F.when(F.col("product_class").isNotNull(), F.array(F.lower("product_class"))), "classes")
    base = placed.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.transform(F.array_sort(F.collect_list(F.struct("place", "product_id"))), lambda x: x["product_id"]).alias("ids"))
    tables = [base, tags, classes]
    for column, _, _ in RANGES:
        value = F.col(column).cast("double")
        known = placed.select("word", value.alias("value"), "bit").filter("value IS NOT NULL").groupBy("word", "value").agg(F.bit_or("bit").alias("bits"))
        upto = F.bit_or("bits").over(Window.partitionBy("word").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        steps = known.select("word", F.struct("value", upto.alias("upto")).alias("step"))
        tables.append(steps.groupBy("word").agg(F.array_sort(F.collect_list("step")).alias(column)))
    return reduce(lambda a, b: a.join(b, "word", "left"), tables)


def _last_upto(steps: Column, test) -> Column:
    """Products whose value passes ``test``, which holds from the smallest value on."""
    return bind(F.filter(steps, lambda s: test(s["value"])), lambda held: F.coalesce(F.get(held, F.size(held) - 1)["upto"], _zero()))


def _any_of(tags: Column, wanted: Column) -> Column:
    return F.aggregate(wanted, _zero(), lambda bits, t: bits.bitwiseOR(F.coalesce(tags[t], _zero())))


def _unless(no_condition: Column, bits: Column) -> Column:
    """All bits where a query sets no such condition; no other bits are computed then."""
    return F.when(no_condition, F.lit(-1).cast("bigint")).otherwise(bits)


def hits(word, query, class_text: bool = False) -> Column:
    """The products of a word that meet all conditions of a prepared query, as bits; both arguments map a name to a column."""
    bits, any_condition = word("bits"), F.lit(False)
    for column, param, upper in RANGES:
        bound, steps = query(param), F.coalesce(word(column), F.array().cast("array<struct<value: double, upto: bigint>>"))
        if upper:
            inside = _last_upto(steps, lambda v, b=bound: v <= b)
        else:
            inside = _last_upto(steps, lambda v: F.lit(True)).bitwiseAND(F.bitwise_not(_last_upto(steps, lambda v, b=bound: v < b)))
        bits = bits.bitwiseAND(_unless(bound.isNull(), inside))
        any_condition |= bound.isNotNull()
    tags = word("tags")
    for attribute in LIST_ATTRIBUTES:
        wanted, unwanted = query(attribute), query(f"{attribute}_negated")
        bits = bits.bitwiseAND(_unless(wanted.isNull(), _any_of(tags, tagged(wanted, attribute))))
        bits = bits.bitwiseAND(_unless(unwanted.isNull(), F.bitwise_not(_any_of(tags, tagged(unwanted, attribute)))))
        any_condition |= wanted.isNotNull() | unwanted.isNotNull()
    if class_text:
        named = F.lower(query("product_class"))
        entries = F.coalesce(F.map_entries(word("classes")), F.array().cast("array<struct<key: string, value: bigint>>"))
        of_class = F.aggregate(F.filter(entries, lambda e: F.contains(e["key"], named)), _zero(), lambda b, e: b.bitwiseOR(e["value"]))
        bits = bits.bitwiseAND(_unless(~any_condition | named.isNull() | (named == ""), of_class))
    return bits


def bitmap_hits(index: DataFrame, queries: DataFrame, absent: str = "positive", class_text: bool = False) -> DataFrame:
    """(query_id, word, ids, hits) of every query and word with a product left.

    A query that asks for an attribute meets the words one of its values occurs in, others meet all words. These are dealt
    over keys of ``SLICE`` words, as many as the index has.
    """
    slices = max(1, -(-index.count() // SLICE))
    q = prepare_params(queries, absent)
    wanted = F.lit(None).cast("array<string>")
    for attribute in reversed(LIST_ATTRIBUTES):
        wanted = F.when(F.col(attribute).isNotNull(), tagged(F.col(attribute), attribute)).otherwise(wanted)
    params = [*LIST_ATTRIBUTES, *(f"{a}_negated" for a in LIST_ATTRIBUTES), *(r[1] for r in RANGES), "product_class"]
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.concat(F.lit("any#"), i.cast("string")))
    left = q.withColumn("wanted", wanted).select("query_id", F.struct(*params, "wanted").alias("q"), F.explode(F.coalesce("wanted", everywhere)).alias("anchor"))
    tags = F.coalesce("tags", F.create_map().cast("map<string, bigint>"))
    own = F.concat(F.lit("any#"), (F.floor(F.col("word") / SLICE)).cast("string"))
    words = index.withColumn("tags", tags)
    right = words.select(F.struct(*words.columns).alias("w"), F.explode(F.array_append(F.map_keys("tags"), own)).alias("anchor"))
    # Of several wanted values in a word the first counts.
    present = F.filter(F.col("q.wanted"), lambda t: F.map_contains_key(F.col("w.tags"), t))
    first = F.col("q.wanted").isNull() | (F.get(present, F.lit(0)) == F.col("anchor"))
    met = right.join(small_side(left), "anchor").filter(first)
    found = hits(lambda n: F.col(f"w.{n}"), lambda n: F.col(f"q.{n}"), class_text)
    # As the output of a generator the bits are computed once, whatever is asked of them later.
    left_over = F.explode(F.filter(F.array(found), lambda bits: bits != 0))
    return met.select("query_id", "w.word", "w.ids", left_over.alias("hits"))


def bitmap_filter(products: DataFrame, queries: DataFrame, absent: str = "positive", class_text: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Matching (query_id, product_id) pairs, the same rows as ``param_filter``; ``index`` may be kept from an earlier search."""
    index = materialize(bitmap_index(products)) if index is None else index
    met = bitmap_hits(index, queries, absent, class_text)
    kept = F.filter("ids", lambda _, i: F.getbit(F.col("hits"), i) == 1)
    return met.select("query_id", F.explode(kept).alias("product_id"))
