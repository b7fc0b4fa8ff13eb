"""Price derivation from class ranges, attribute weights and ratings."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.functions.lookup import as_array, as_map, fits_inline, last_of, small_side

# Fixed values of the price model.
CONSTANT_Z = 0.4967141530112327  # first standard normal draw for seed 42
ATTRIBUTE_BONUS = 0.1
RATING_BOUNDS = (1.0, 5.0)
RATING_MULTIPLIER_BOUNDS = (0.8, 1.4)
COMBINED_BOUNDS = (0.3, 3.5)


def attribute_multiplier(values: Column, weights: Column) -> Column:
    """1 for an empty list, else the mean weight of the known values (0 if none) plus a bonus."""
    known = F.filter(F.transform(values, lambda v: F.try_element_at(weights, F.lower(v))), lambda w: w.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, w: a + w) / F.greatest(F.size(known), F.lit(1))
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(1.0)).otherwise(mean + ATTRIBUTE_BONUS)


def rating_multiplier(rating: Column, thresholds: Column) -> Column:
    """First threshold in file order that holds the clamped rating; 1 without rating or match."""
    clamped = F.least(F.greatest(rating, F.lit(RATING_BOUNDS[0])), F.lit(RATING_BOUNDS[1]))
    fits = F.filter(thresholds, lambda t: clamped.between(t.low, t.high))
    found = F.coalesce(F.get(fits, F.lit(0)).multiplier, F.lit(1.0))
    bounded = F.greatest(F.lit(RATING_MULTIPLIER_BOUNDS[0]), F.least(found, F.lit(RATING_MULTIPLIER_BOUNDS[1])))
    return F.when(rating.isNull() | F.isnan(rating), F.lit(1.0)).otherwise(bounded)


def rating_confidence(rating: Column, count: Column) -> Column:
    """0 without rating, 0.5 without count, else the count in hundreds up to 1."""
    return (
        F.when(rating.isNull() | F.isnan(rating), F.lit(0.0))
        .when(count.isNull(), F.lit(0.5))
        .otherwise(F.least(F.greatest(count.cast("double"), F.lit(1.0)) / 100, F.lit(1.0)))
    )


def round_price(price: Column) -> Column:
    """Nearest 5, 25 or 100 depending on size, ties to the even multiple."""
    step = F.when(price < 100, F.lit(5.0)).when(price < 1000, F.lit(25.0)).otherwise(F.lit(100.0))
    return F.rint(price / step) * step


def base_price(low: Column, high: Column, z=CONSTANT_Z) -> Column:
    """Normal price between the ends; ``z`` is the standard normal draw, one constant by default."""
    z = z if isinstance(z, Column) else F.lit(float(z))
    return (low + high) / 2 + (high - low) / 6 * z


def _weight_map(weights: DataFrame, feature_type: str) -> Column:
    return as_map(weights.filter(F.col("feature_type") == feature_type), "item", "weight")


def add_multipliers(df: DataFrame, weights: DataFrame, thresholds: DataFrame, country_column: str | None = None, use_rating: bool = True) -> DataFrame:
    """Add material, style, country and rating multipliers.

    ``weights`` has (feature_type, item, weight); of a repeated item the last row by ``seq``
    counts, the largest weight without that column. ``thresholds`` is a short list of bands.
    The country multiplier stays 1 unless a country column is named.
    """
    weights = last_of(weights, ["feature_type", "item"], "weight")
    if not fits_inline(weights):
        return _add_multipliers_joined(df, weights, thresholds, country_column, use_rating)
    sources = {"material": "material", "style": "style"}
    if country_column:
        sources["countryoforigin"] = country_column
    keep = df.columns
    df = df.withColumns({f"_{t}_weights": _weight_map(weights, t) for t in sources})
    df = df.withColumn("_thresholds", as_array(thresholds, "seq", "low", "high", "multiplier"))
    added = {
        f"{t if t != 'countryoforigin' else 'country'}_multiplier": attribute_multiplier(F.col(c), F.col(f"_{t}_weights"))
        for t, c in sources.items()
    }
    added.setdefault("country_multiplier", F.lit(1.0))
    added["rating_multiplier"] = rating_multiplier(F.col("average_rating"), F.col("_thresholds")) if use_rating else F.lit(1.0)
    return df.withColumns(added).select(*keep, *added)


def _add_multipliers_joined(df, weights, thresholds, country_column, use_rating, key="product_id"):
    """The same for weight tables too large to travel inside the plan."""
    sources = {"material": "material", "style": "style"}
    if country_column:
        sources["countryoforigin"] = country_column
    # Rows that share a key may hold other lists, so key and lists together name what is regrouped.
    ids = {f"_id{i}": c for i, c in enumerate(dict.fromkeys([key, *sources.values()]))}
    named = {c: n for n, c in ids.items()}
    pairs = F.array(*[F.struct(F.lit(t).alias("feature_type"), F.col(named[c]).alias("items")) for t, c in sources.items()])
    matched = (
        df.select(*[F.col(c).alias(n) for n, c in ids.items()]).distinct()
        .select(*ids, F.explode(pairs).alias("pair"))
        .select(*ids, "pair.feature_type", F.explode("pair.items").alias("value"))
        .select(*ids, "feature_type", F.lower("value").alias("item"))
        .join(last_of(weights, ["feature_type", "item"], "weight"), ["feature_type", "item"], "left")
        .groupBy(*ids)
        .agg(*[
            F.when(F.count_if(F.col("feature_type") == t) > 0,
                   F.coalesce(F.avg(F.when(F.col("feature_type") == t, F.col("weight"))), F.lit(0.0)) + ATTRIBUTE_BONUS).alias(f"_{t}")
            for t in sources
        ])
    )
    keep = df.columns
    same = F.lit(True)
    for n, c in ids.items():
        same &= df[c].eqNullSafe(matched[n])
    joined = df.join(matched, same, "left")
    joined = joined.withColumn("_thresholds", as_array(thresholds, "seq", "low", "high", "multiplier"))
    added = {f"{t if t != 'countryoforigin' else 'country'}_multiplier": F.coalesce(f"_{t}", F.lit(1.0)) for t in sources}
    added.setdefault("country_multiplier", F.lit(1.0))
    added["rating_multiplier"] = rating_multiplier(F.col("average_rating"), F.col("_thresholds")) if use_rating else F.lit(1.0)
    return joined.withColumns(added).select(*keep, *added)


def realistic_price(low: Column, high: Column, multiplier: Column, z=CONSTANT_Z) -> Column:
    """Rounded price of a class range under a bounded multiplier; null without a range."""
    bounded = F.greatest(F.least(multiplier, F.lit(COMBINED_BOUNDS[1])), F.lit(COMBINED_BOUNDS[0]))
    return F.abs(round_price(base_price(low * bounded, high * bounded, z)))


def add_prices(
    df: DataFrame, ranges: DataFrame, weights: DataFrame, thresholds: DataFrame,
    country_column: str | None = None, use_rating: bool = True, z=CONSTANT_Z, out: str = "price",
) -> DataFrame:
    """Price every row whose class has a range (product_class, price_min, price_max); others get null."""
    keep = [c for c in df.columns if c != out]
    priced = add_multipliers(df.select(*keep), weights, thresholds, country_column, use_rating).join(small_side(ranges), "product_class", "left")
    multiplier = (
        F.col("material_multiplier") * F.col("style_multiplier") * F.col("country_multiplier") * F.col("rating_multiplier")
    )
    return priced.select(*keep, realistic_price(F.col("price_min"), F.col("price_max"), multiplier, z).alias(out))


def pricing_counters(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows priced, rows without class range, priced rows with and without rating."""
    flagged = df.join(small_side(ranges.select("product_class", F.lit(True).alias("known"))), "product_class", "left")
    priced = F.col("known").isNotNull()
    rated = F.col("average_rating").isNotNull()
    return flagged.agg(
        F.count_if(priced).alias("priced"),
        F.count_if(~priced).alias("missing_class"),
        F.count_if(priced & rated).alias("with_rating"),
        F.count_if(priced & ~rated).alias("without_rating"),
    )
