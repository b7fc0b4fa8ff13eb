"""Catalogue cleaning: feature parsing, vocabulary normalisation, imputation, sampling, ids."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.functions.draws import triangular, uniform
from shelfrank.functions.lookup import as_map, bind, fits_inline, last_of, small_side
from shelfrank.functions.ranking import quantiles, stack_columns
from shelfrank.functions.text import clean_value, strip
from shelfrank.session import materialize

ATTRIBUTES = ("material", "style", "color", "countryoforigin")
# The word in a feature name that marks each attribute.
FEATURE_MARKERS = {"material": "material", "style": "style", "color": "color", "countryoforigin": "country"}
CATEGORY_COLUMNS = ("color", "material", "style", "product_class")
STRING_LIST = "array<string>"


def empty_list() -> Column:
    return F.array().cast(STRING_LIST)


# ---------------------------------------------------------------- features


def feature_items(features: Column) -> Column:
    """``k : v|k : v`` text to an array of (key, value).

    Items without a colon do not count; a repeated key keeps its first place and its
    last value.
    """
    raw = F.filter(F.split(features, r"\|"), lambda item: F.contains(item, F.lit(":")))
    pairs = F.transform(
        raw,
        lambda item: F.struct(
            strip(F.substring_index(item, ":", 1)).alias("key"),
            strip(F.substr(item, F.instr(item, ":") + 1)).alias("value"),
        ),
    )

    def last_values(items):
        keys = F.array_distinct(F.transform(items, lambda p: p.key))
        return F.transform(
            keys,
            lambda k: F.struct(k.alias("key"), F.element_at(F.filter(items, lambda p: p.key == k), -1).value.alias("value")),
        )

    return bind(pairs, last_values)


def parse_features(df: DataFrame, column: str = "product_features") -> DataFrame:
    """Add the four attribute lists; an attribute no feature name mentions stays null."""


    def marked(marker):
        return F.transform(F.filter("_items", lambda i: F.contains(F.lower(i.key), F.lit(marker))), lambda i: i.value)

    df = df.withColumn("_items", feature_items(F.col(column)))
    for attribute, marker in FEATURE_MARKERS.items():
        df = df.withColumn(attribute, bind(marked(marker), lambda v: F.when(F.size(v) > 0, v)))
    return df.drop("_items")


def filter_features(df: DataFrame, column: str = "product_features") -> DataFrame:
    """Rows with all four attributes; styles and colours sorted, the other two in given order."""
    parsed = parse_features(df, column)
    present = F.lit(True)
    for attribute in ATTRIBUTES:
        present = present & F.col(attribute).isNotNull()
    return (
        parsed.filter(present)
        .withColumn("style", F.array_sort("style"))
        .withColumn("color", F.array_sort("color"))
        .drop(column)
    )


# ---------------------------------------------------------------- vocabulary


def valid_values(lookup: DataFrame) -> DataFrame:
    """Distinct targets per category of a (category, raw, normalized list) lookup."""
    return lookup.select("category", F.explode("normalized").alias("value")).distinct()


def _targets(lookup: DataFrame) -> DataFrame:
    """The lookup plus one row that maps each valid target to itself.

    What this table does not know is not valid, so one look-up both maps and filters. Of a
    repeated raw value the last row counts (the largest list where rows have no ``seq``).
    """
    known = last_of(lookup, ["category", "raw"], "normalized")
    itself = valid_values(known).select("category", F.col("value").alias("raw"), F.array("value").alias("normalized"))
    return known.unionByName(itself.join(known.select("category", "raw"), ["category", "raw"], "left_anti"))


def _normalize_inline(df, lookup, categories):
    columns = df.columns
    table = _targets(lookup)
    maps = {col: as_map(table.filter(F.col("category") == cat), "raw", "normalized") for col, cat in categories.items()}
    df = df.withColumns({f"_{col}_targets": m for col, m in maps.items()})

    def mapped(column):
        targets = F.col(f"_{column}_targets")
        lists = F.transform(column, lambda v: F.coalesce(F.try_element_at(targets, F.lower(strip(v))), empty_list()))
        return F.coalesce(F.array_distinct(F.flatten(lists)), empty_list())

    return df.withColumns({c: mapped(c) for c in categories}).select(*columns)


def _normalize_joined(df, lookup, categories, key):
    # Rows that share a key may hold other lists, so key and lists together name what is regrouped.
    ids = {f"_id{i}": c for i, c in enumerate(dict.fromkeys([key, *categories]))}
    named = {c: n for n, c in ids.items()}
    pairs = F.array(*[F.struct(F.lit(cat).alias("category"), F.col(named[col]).alias("items")) for col, cat in categories.items()])
    values = (
        df.select(*[F.col(c).alias(n) for n, c in ids.items()]).distinct()
        .select(*ids, F.explode(pairs).alias("pair"))
        .select(*ids, "pair.category", F.posexplode("pair.items").alias("pos", "item"))
        .withColumn("raw", F.lower(strip("item")))
    )
    mapped = values.join(_targets(lookup), ["category", "raw"]).select(
        *ids, "category", "pos", F.posexplode("normalized").alias("sub", "value")
    )
    # A product holds few values per attribute, so the lists collected here are short.
    collected = mapped.groupBy(*ids).agg(
        *[
            F.array_distinct(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("category") == cat, F.struct("pos", "sub", "value")))),
                    lambda s: s.value,
                )
            ).alias(f"_{col}")
            for col, cat in categories.items()
        ]
    )
    same = F.lit(True)
    for n, c in ids.items():
        same &= df[c].eqNullSafe(collected[n])
    joined = df.join(collected, same, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", empty_list()) for c in categories}).select(*df.columns)


def normalize_values(df: DataFrame, lookup: DataFrame, categories, key: str = "product_id", method: str = "auto") -> DataFrame:
    """Map list values onto the vocabulary, keep valid ones, drop repeats, keep first-seen order.

    ``lookup`` has (category, raw, normalized list), ``categories`` maps list columns to
    categories. A small vocabulary is applied in place without any shuffle; a large one
    is joined on (category, raw) and regrouped per product.
    """
    if method == "auto":
        method = "inline" if fits_inline(lookup) else "join"
    if method == "inline":
        return _normalize_inline(df, lookup, categories)
    return _normalize_joined(df, lookup, categories, key)


def normalize_features(df: DataFrame, lookup: DataFrame, key: str = "product_id", method: str = "auto") -> DataFrame:
    """All four attributes at once."""
    return normalize_values(df, lookup, {a: a for a in ATTRIBUTES}, key, method)


def remap_class(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace classes found in (product_class, product_class_fixed); others stay."""
    return (
        df.join(small_side(mapping), "product_class", "left")
        .withColumn("product_class", F.coalesce("product_class_fixed", "product_class"))
        .select(*df.columns)
    )


def unique_categories(df: DataFrame, columns=CATEGORY_COLUMNS) -> DataFrame:
    """Distinct stripped, non-blank values of list or string columns: (category, value)."""
    lists = [
        F.struct(
            F.lit(c).alias("category"),
            (F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(c)).alias("items"),
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*lists)).alias("pair"))
        .select("pair.category", F.explode("pair.items").alias("value"))
        .withColumn("value", strip("value"))
        .filter(F.col("value") != "")
        .distinct()
    )


# ---------------------------------------------------------------- missing values


def fill_description(df: DataFrame) -> DataFrame:
    """Null descriptions become name, class and attributes; null when name or class is null."""
    parts = [F.col("product_name"), F.col("product_class")]
    parts += [F.array_join(c, ", ") for c in ("color", "style", "material", "countryoforigin")]
    spaced = [p for part in parts for p in (F.lit(", "), part)][1:]
    return df.withColumn("product_description", F.coalesce("product_description", F.concat(*spaced)))


def impute_mean_median(df: DataFrame) -> DataFrame:
    """Null ratings become the mean, null rating counts the exact median."""
    mean = df.agg(F.avg("average_rating")).scalar()
    median = quantiles(stack_columns(df, ["rating_count"]), {"median": 0.5}, True).select("value").scalar()
    return df.withColumn("average_rating", F.coalesce("average_rating", mean)).withColumn(
        "rating_count", F.coalesce(F.col("rating_count").cast("double"), median)
    )


def repair_numeric(df: DataFrame, seed: int = 42, key: str = "product_id") -> DataFrame:
    """Ratings below 3 and rating counts below 100 are redrawn; other counts lose their fraction."""
    rating = F.round(triangular(uniform(seed, "rating", key), 3.0, 5.0, 4.2), 1)
    count = F.floor(triangular(uniform(seed, "rating_count", key), 100.0, 10000.0, 1000.0))
    return df.withColumn(
        "average_rating", F.when(F.col("average_rating") < 3.0, rating).otherwise(F.col("average_rating"))
    ).withColumn(
        "rating_count", F.when(F.col("rating_count") < 100, count).otherwise(F.col("rating_count").cast("long")).cast("long")
    )


def filter_complete(df: DataFrame) -> DataFrame:
    """Rows whose four lists all hold something."""
    keep = F.lit(True)
    for attribute in ATTRIBUTES:
        keep = keep & (F.size(attribute) > 0)
    return df.filter(keep)


def drop_null_description(df: DataFrame) -> DataFrame:
    return df.filter(F.col("product_description").isNotNull())


def null_audit(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass: (column_name, nulls)."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "nulls")


# Bytes of one partition of a forest's training rows: a row is a place per feature and a count per tree there, whatever its words.
TRAINING_BYTES = 256 << 20


def training_rows(df: DataFrame, features: int, trees: int, most_bytes: int = TRAINING_BYTES) -> DataFrame:
    """``df`` dealt evenly into as many partitions as keep each one's training rows within ``most_bytes``; a table that fits one stays as it is."""
    parts = -(-df.count() * 4 * (features + trees) // most_bytes)
    return df.repartition(parts) if parts > 1 else df


def predict_class(df: DataFrame, trees: int = 100, seed: int = 42, features: int = 2**12, depth: int = 10) -> DataFrame:
    """Fill null classes with a random forest trained on the rows that have one.

    Texts become frequency-weighted words, hashed to ``features`` places; a tree may grow to
    ``depth`` levels, so to a thousand leaves. Both bound the model the driver
    holds, not the rows. Nothing is trained when no class is missing.
    """
    if df.filter(F.col("product_class").isNull()).isEmpty():
        return df
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    text = F.concat(F.coalesce("product_name", F.lit("")), F.lit(" "), F.coalesce("product_description", F.lit("")))
    rows = df.withColumn("_text", text)
    known = rows.filter(F.col("product_class").isNotNull())
    unknown = rows.filter(F.col("product_class").isNull())
    labels = StringIndexer(inputCol="product_class", outputCol="_label", stringOrderType="alphabetAsc").fit(known)
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            RandomForestClassifier(
                labelCol="_label", featuresCol="_features", predictionCol="_guess",
                rawPredictionCol="_raw", probabilityCol="_probability", numTrees=trees, seed=seed, maxDepth=depth,
            ),
            IndexToString(inputCol="_guess", outputCol="_class", labels=labels.labels),
        ]
    )
    model = pipeline.fit(training_rows(labels.transform(known), features, trees))
    filled = model.transform(unknown).withColumn("product_class", F.col("_class"))
    return known.select(*df.columns).unionByName(filled.select(*df.columns))


# ---------------------------------------------------------------- sampling and ids


SLICE_ROWS = 5000


def sample_n_sorted(df: DataFrame, n: int = 10000, seed: int = 42, key: str = "product_id") -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a hash of seed and key, sorted by key.

    Hash prefixes split the rows into even slices of a few thousand rows. Whole slices are
    taken or left by their counts; rows are only ordered inside the slice where the cut falls.
    """
    rows, digits = df.count(), 1
    # At most a million slices, so their running total is a small window.
    while digits < 5 and rows > SLICE_ROWS * 16**digits:
        digits += 1
    keyed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))).withColumn(
        "_slice", F.substring("_hash", 1, digits)
    )
    running = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        keyed.groupBy("_slice").agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .filter(F.col("_before") < n)
    )
    inside = Window.partitionBy("_slice").orderBy("_hash", key)
    return (
        keyed.join(slices, "_slice")
        .withColumn("_place", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("_place") <= n)
        .select(*df.columns)
        .orderBy(key)
    )


def union_synthetic(df: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Append rows, columns matched by name, missing ones null."""
    return df.unionByName(synthetic, allowMissingColumns=True)


def assign_dense_ids(df: DataFrame, order, prefix: str = "product_", column: str = "product_id") -> DataFrame:
    """Number the rows 1..n in the given order without gathering them in one task.

    The rows are range-sorted and written out once; partition sizes give each
    partition its offset, and rows are counted inside their partition. ``order`` must
    name a unique order for repeatable ids.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    )
    # One row per partition: the window is as small as the partition count.
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .select("_part", "_first", "_offset")
    )
    number = F.col("_offset") + F.col("_place") - F.col("_first") + 1
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.concat(F.lit(prefix), number.cast("string")))
        .select(*[c for c in df.columns if c != column], column)
    )


# ---------------------------------------------------------------- row shaping


def clean_text_values(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, clean_value(F.col(column)))


def cast_float32(df: DataFrame, id_column: str = "product_id", floats=("rating_count", "average_rating", "price")) -> DataFrame:
    """Id as text, numeric columns as 32-bit floats, description led by the name."""
    return (
        df.withColumn(id_column, F.col(id_column).cast("string"))
        .withColumns({c: F.col(c).cast("float") for c in floats})
        .withColumn("product_description", F.concat("product_name", F.lit(" "), "product_description"))
    )


def stringify_row(df: DataFrame, columns, out: str = "text") -> DataFrame:
    """``col: value, col: value`` text of the row; lists print as lists, nulls as None."""

    def shown(c):
        if df.schema[c].dataType.typeName() == "array":
            text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
        else:
            text = F.col(c).cast("string")
        return F.concat(F.lit(f"{c}: "), F.coalesce(text, F.lit("None")))

    return df.withColumn(out, F.concat_ws(", ", *[shown(c) for c in columns]))


def dedupe_latest(df: DataFrame, key: str = "product_id", seq: str = "seq") -> DataFrame:
    """The last row of every key by ``seq``; rows without key are dropped.

    Partial results are merged before the shuffle, so a key repeated very often stays cheap.
    """
    return (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(key)
        .agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(seq)).alias("row"))
        .select(key, "row.*")
    )
