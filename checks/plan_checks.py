"""The whole pipelines on the derived catalogue."""

from pyspark.sql import functions as F

from checks.fixtures import class_mapping_frame, lookup_frame, ranges_frame, table, thresholds_frame, view, weights_frame
from checks.fixtures import class_mapping_duck, duck, ranges_duck, thresholds_duck, weights_duck
from checks.catalog_checks import NORMALIZE, P, REPAIR
from checks.pricing_checks import PRICE_STEPS, attr
from checks.registry import check, rounded
from shelfrank.operators.textsearch import fielded_search
from shelfrank.operators.retrieval import result_lists
from shelfrank.plans import benchmark as bm
from shelfrank.plans.catalog import build_catalog



def catalog(spark, sf):
    raw = view(spark, sf, "p").drop("p_partkey")
    synthetic = table(spark, sf, "supplier").select(
        F.concat(F.lit("s_"), F.col("s_suppkey")).alias("product_id"), F.col("s_name").alias("product_name"), F.lit("PROMO").alias("product_class"),
        F.array(F.lit("wood")).alias("material"), F.array(F.lit("glam")).alias("style"), F.lit(4.6).alias("average_rating"),
    )
    return build_catalog(
        raw, lookup_frame(spark), class_mapping_frame(spark), ranges_frame(spark), weights_frame(spark), thresholds_frame(spark),
        synthetic, predict=False,
    )


CATALOG = f"""WITH {P}, {NORMALIZE}{REPAIR}, {class_mapping_duck()}, {weights_duck()}, {thresholds_duck()}, {ranges_duck()},
sampled AS (SELECT product_id, product_name, product_class, material, style, average_rating, rating_count FROM repaired WHERE product_description IS NOT NULL),
united AS (SELECT *, false AS syn FROM sampled UNION ALL SELECT 's_' || s_suppkey, s_name, 'PROMO', ['wood'], ['glam'], 4.6::double, NULL, true FROM supplier),
c AS (SELECT 'product_' || row_number() OVER (ORDER BY syn, u.product_id) AS product_id, product_name, coalesce(m.product_class_fixed, u.product_class) AS product_class, material, style, average_rating, rating_count
  FROM united u LEFT JOIN class_mapping m ON m.product_class = u.product_class),
{attr('material', 'material', 'mm')}, {attr('style', 'style', 'sm')},
rm AS (SELECT product_id, greatest(0.8::double, least(coalesce((SELECT arg_min(multiplier, seq) FROM thresholds WHERE least(greatest(average_rating, 1.0), 5.0) BETWEEN low AND high), 1.0::double), 1.4::double)) AS m FROM c)
SELECT product_id, product_name, product_class, {rounded('average_rating', 6)} AS average_rating, rating_count, abs({PRICE_STEPS('x')}) AS price FROM (
 SELECT c.*, (price_min * mult + price_max * mult) / 2 + (price_max * mult - price_min * mult) / 6 * 0.4967141530112327::double AS x FROM c LEFT JOIN ranges USING (product_class)
 JOIN (SELECT product_id, greatest(least(mm.m * sm.m * rm.m, 3.5::double), 0.3::double) AS mult FROM mm JOIN sm USING (product_id) JOIN rm USING (product_id)) f USING (product_id)) z"""


@check("build_catalog", CATALOG)
def _(spark, sf):
    return catalog(spark, sf).select("product_id", "product_name", "product_class", F.round("average_rating", 6).alias("average_rating"), "rating_count", "price")


@check("build_benchmark")
def _(spark, sf):
    products = view(spark, sf, "c")
    queries, hits = bm.build_query_set(products, targets={"simple": 4, "negation": 4, "number": 4, "complex": 4}, attempts=2)
    queries, hits = bm.enrich_query_set(queries, hits, products, bm.mined_features(queries, hits, products))
    truth = bm.build_ground_truth(queries, hits, products)
    synthetic = table(spark, sf, "benchmark").select(F.concat(F.lit("synth-"), F.col("item_id")).alias("query_id"), F.lit("synth").alias("query_type"), F.col("text").alias("query_text"))
    lists = products.groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda p: F.concat(F.lit("product_"), p)).alias("product_ids"))
    queries, truth = bm.add_synthetic(queries, truth, synthetic, lists.select(F.concat(F.lit("synth-"), "k").alias("query_id"), "product_ids"))
    plain = result_lists(queries, fielded_search(products, queries, 10, "query_text", filtered=False))
    filtered = result_lists(queries, fielded_search(products, queries, 10, "query_text"))
    report, _by_query = bm.evaluate_systems({"plain-text": plain, "with-filters": filtered}, truth)
    return report
