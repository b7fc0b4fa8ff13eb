"""Catalogue build: raw table to priced products."""

from pyspark.sql import DataFrame

from shelfrank.operators import catalog as cat
from shelfrank.operators.pricing import add_prices
from shelfrank.session import materialize

def clean_products(raw: DataFrame, lookup: DataFrame, seed: int = 42, predict: bool = True) -> DataFrame:
    """Complete products with normalised attributes, filled gaps and repaired numbers.

    Means and medians are taken before incomplete rows go. The normalised table feeds
    several passes, so it is written out once.
    """
    columns = [c for c in raw.columns if c not in ("product_features", "review_count")]
    normalized = cat.normalize_features(cat.filter_features(raw), lookup).select(*columns, *cat.ATTRIBUTES)
    described = materialize(cat.fill_description(normalized))
    classed = cat.predict_class(described, seed=seed) if predict else described
    complete = cat.filter_complete(cat.impute_mean_median(classed))
    return cat.drop_null_description(cat.repair_numeric(complete, seed))


def build_catalog(
    raw: DataFrame, lookup: DataFrame, class_mapping: DataFrame, ranges: DataFrame, weights: DataFrame, thresholds: DataFrame,
    synthetic: DataFrame | None = None, sample: int | None = None, seed: int = 42, predict: bool = True,
) -> DataFrame:
    """Final catalogue: clean, sample, append synthetic rows, number, map classes, price.

    Every product is kept unless ``sample`` asks for that many. Sampled rows come first in id order, then the
    synthetic ones.
    """
    from pyspark.sql import functions as F

    products = clean_products(raw, lookup, seed, predict)
    if sample is not None:
        products = cat.sample_n_sorted(products, sample, seed)
    products = products.withColumn("_synthetic", F.lit(False))
    if synthetic is not None:
        products = cat.union_synthetic(products, synthetic.withColumn("_synthetic", F.lit(True)))
    numbered = cat.assign_dense_ids(products, ["_synthetic", "product_id"]).drop("_synthetic")
    return add_prices(cat.remap_class(numbered, class_mapping), ranges, weights, thresholds)
