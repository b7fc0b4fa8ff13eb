"""Price derivation on the whole derived catalogue."""

from pyspark.sql import functions as F

from checks.fixtures import class_mapping_duck, duck, lookup_duck, ranges_duck, ranges_frame, thresholds_duck, thresholds_frame, view, weights_duck, weights_frame
from checks.registry import check, rounded
from shelfrank.operators import pricing as pr


def attr(column, kind, out):
    return f"""{out} AS (SELECT product_id, CASE WHEN len({column}) = 0 THEN 1.0::double ELSE coalesce(s, 0) / greatest(n, 1) + 0.1::double END AS m FROM c LEFT JOIN
 (SELECT product_id AS pid, sum(weight) AS s, count(weight) AS n FROM (SELECT product_id, unnest({column}) AS v FROM c) u LEFT JOIN weights w ON w.feature_type = '{kind}' AND w.item = lower(v) GROUP BY ALL) a ON a.pid = c.product_id)"""


PRICE_STEPS = lambda x: f"(CASE WHEN {x} < 100 THEN round_even({x} / 5, 0) * 5 WHEN {x} < 1000 THEN round_even({x} / 25, 0) * 25 ELSE round_even({x} / 100, 0) * 100 END)"


def priced(name, factor):
    return f"""{name} AS (SELECT product_id, product_class, abs({PRICE_STEPS('x')}) AS price FROM (
  SELECT f.*, (lo + hi) / 2 + (hi - lo) / 6 * 0.4967141530112327::double AS x FROM
   (SELECT *, greatest(least({factor}, 3.5::double), 0.3::double) AS mult FROM factors) f
   LEFT JOIN ranges r USING (product_class), LATERAL (SELECT r.price_min * mult AS lo, r.price_max * mult AS hi) e) z)"""


BASE = f"""{duck('c')}, {weights_duck()}, {thresholds_duck()}, {ranges_duck()},
{attr('material', 'material', 'mm')}, {attr('style', 'style', 'sm')}, {attr('countryoforigin', 'countryoforigin', 'cm')},
rm AS (SELECT product_id, CASE WHEN average_rating IS NULL THEN 1.0::double ELSE greatest(0.8::double, least(coalesce((SELECT arg_min(multiplier, seq) FROM thresholds
   WHERE least(greatest(average_rating, 1.0), 5.0) BETWEEN low AND high), 1.0::double), 1.4::double)) END AS m FROM c),
factors AS (SELECT c.*, mm.m AS material_multiplier, sm.m AS style_multiplier, cm.m AS country_multiplier, rm.m AS rating_multiplier
  FROM c JOIN mm USING (product_id) JOIN sm USING (product_id) JOIN cm USING (product_id) JOIN rm USING (product_id)),
{priced('priced', 'material_multiplier * style_multiplier * rating_multiplier')},
{priced('priced_country', 'material_multiplier * style_multiplier * country_multiplier * rating_multiplier')}"""


def products(spark, sf):
    return view(spark, sf, "c")


def multipliers(spark, sf):
    return pr.add_multipliers(products(spark, sf), weights_frame(spark), thresholds_frame(spark), "countryoforigin")


@check("attr_multiplier", f"WITH {BASE} SELECT product_id, {rounded('material_multiplier', 9)} AS material_multiplier, {rounded('style_multiplier', 9)} AS style_multiplier, {rounded('country_multiplier', 9)} AS country_multiplier FROM factors")
def _(spark, sf):
    return multipliers(spark, sf).select("product_id", *[F.round(c, 9).alias(c) for c in ("material_multiplier", "style_multiplier", "country_multiplier")])


@check("rating_multiplier", f"WITH {BASE} SELECT product_id, average_rating, rating_multiplier FROM factors")
def _(spark, sf):
    return multipliers(spark, sf).select("product_id", "average_rating", "rating_multiplier")


@check("rating_confidence", f"""WITH {duck('p')} SELECT product_id, CASE WHEN average_rating IS NULL THEN 0.0::double WHEN rating_count IS NULL THEN 0.5::double
 ELSE least(greatest(rating_count, 1.0) / 100, 1.0::double) END AS confidence FROM p""")
def _(spark, sf):
    return view(spark, sf, "p").select("product_id", pr.rating_confidence(F.col("average_rating"), F.col("rating_count")).alias("confidence"))


@check("round_price", f"SELECT l_orderkey, l_linenumber, l_extendedprice, {PRICE_STEPS('l_extendedprice')} AS price, {PRICE_STEPS('l_quantity * 2.5')} AS small_price FROM lineitem")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice", pr.round_price(F.col("l_extendedprice")).alias("price"), pr.round_price(F.col("l_quantity") * 2.5).alias("small_price"))


@check("base_price", f"WITH {duck('c')}, {ranges_duck()} SELECT product_id, {rounded('(price_min + price_max) / 2 + (price_max - price_min) / 6 * 0.4967141530112327::double', 6)} AS base_price FROM c LEFT JOIN ranges USING (product_class)")
def _(spark, sf):
    return products(spark, sf).join(ranges_frame(spark), "product_class", "left").select("product_id", F.round(pr.base_price(F.col("price_min"), F.col("price_max")), 6).alias("base_price"))


@check("realistic_price", f"WITH {BASE} SELECT product_id, price FROM priced_country")
def _(spark, sf):
    m = multipliers(spark, sf).join(ranges_frame(spark), "product_class", "left")
    total = F.col("material_multiplier") * F.col("style_multiplier") * F.col("country_multiplier") * F.col("rating_multiplier")
    return m.select("product_id", pr.realistic_price(F.col("price_min"), F.col("price_max"), total).alias("price"))


@check("add_prices", f"WITH {BASE} SELECT product_id, product_class, price FROM priced")
def _(spark, sf):
    return pr.add_prices(products(spark, sf), ranges_frame(spark), weights_frame(spark), thresholds_frame(spark)).select("product_id", "product_class", "price")


@check("pricing_counters", f"""WITH {duck('c')}, {ranges_duck()} SELECT count(r.product_class) AS priced, count(*) FILTER (r.product_class IS NULL) AS missing_class,
 count(*) FILTER (r.product_class IS NOT NULL AND average_rating IS NOT NULL) AS with_rating, count(*) FILTER (r.product_class IS NOT NULL AND average_rating IS NULL) AS without_rating
 FROM c LEFT JOIN ranges r ON r.product_class = c.product_class""")
def _(spark, sf):
    return pr.pricing_counters(products(spark, sf), ranges_frame(spark))
