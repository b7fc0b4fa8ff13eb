"""Readers with explicit schemas for the files of the pipeline."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfrank.functions.text import strip

RAW_PRODUCT_SCHEMA = (
    "product_id string, product_name string, product_class string, product_description string, "
    "product_features string, rating_count double, average_rating double, review_count double"
)
PRODUCT_SCHEMA = (
    "product_id string, product_name string, product_description string, product_class string, "
    "material array<string>, style array<string>, color array<string>, countryoforigin array<string>, "
    "rating_count bigint, average_rating double, price double"
)
PARAMS_SCHEMA = (
    "struct<product_class: string, product_description: string, style: string, color: string, material: string, "
    "style_negated: string, color_negated: string, material_negated: string, rating_min: double, rating_max: double, "
    "rating_count_min: double, rating_count_max: double, price_min: double, price_max: double, "
    "rating_weight: double, rating_count_weight: double, price_weight: double>"
)
# These hold a string or a list of strings; either is read as its text.
LIST_PARAMS = ("style", "color", "material", "style_negated", "color_negated", "material_negated")
QUERY_SCHEMA = f"query_id string, query_type string, query_text string, query_params {PARAMS_SCHEMA}"
EMBEDDING_SCHEMA = (
    "id string, dense_embedding array<float>, "
    "sparse_embedding struct<indices: array<int>, dimensions: array<int>, values: array<double>>, "
    "metadata struct<product_name: string, product_description: string, product_class: string, price: double, "
    "average_rating: double, rating_count: double, material: array<string>, style: array<string>, color: array<string>>"
)
RANKING_SCHEMA = "query_id string, product_id string, rank int, query_type string"
BROKEN = "_broken_line"


def scan_tsv(spark: SparkSession, path, schema: str = RAW_PRODUCT_SCHEMA, multiline: bool = False) -> DataFrame:
    """Tab-separated table with a header; empty cells are null.

    Quoted cells may hold line breaks only with ``multiline``, which reads each file in
    one task; without it large files are split.
    """
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=multiline)


def scan_jsonl(spark: SparkSession, path, schema: str = PRODUCT_SCHEMA):
    """(rows, rejects) of a file with one JSON object per line; blank lines count as neither.

    A rejected line comes with its text. Whole numbers may be written with a fraction, such
    as 12.0; what is behind the point is dropped. Both tables read the file independently.
    """
    wanted = T.StructType.fromDDL(schema)
    whole = [f.name for f in wanted if isinstance(f.dataType, T.LongType | T.IntegerType)]
    # Whole numbers are read as text, which keeps all digits of large ones.
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in wanted] + [T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).filter(strip("value") != "")
    parsed = lines.select(
        F.col("value"),
        F.from_json("value", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("row"),
    )
    number = lambda c: F.col(f"row.{c}").try_cast("decimal(38,9)").try_cast("bigint")
    bad = F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull()
    for c in whole:
        bad = bad | (F.col(f"row.{c}").isNotNull() & number(c).isNull())
    bad = F.coalesce(bad, F.lit(True))
    columns = [(number(f.name).try_cast(f.dataType) if f.name in whole else F.col(f"row.{f.name}")).alias(f.name) for f in wanted]
    return parsed.filter(~bad).select(*columns), parsed.filter(bad).select(F.col("value").alias("line"))


def scan_json_array(spark: SparkSession, path, schema: str = QUERY_SCHEMA) -> DataFrame:
    """Objects of files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def flatten_params(queries: DataFrame, column: str = "query_params") -> DataFrame:
    """Query parameters as columns next to the query's own; the six attribute parameters as lists, also where one string was given."""
    own = [c for c in queries.columns if c != column]
    flat = queries.select(*own, f"{column}.*")
    return flat.withColumns({c: string_or_list(F.col(c)) for c in LIST_PARAMS if c in flat.columns})


def scan_result_map(spark: SparkSession, path) -> DataFrame:
    """Files that hold one JSON object {query id: [ids]} each, as (query_id, product_ids).

    Such an object is one value, so one file is one task; large result sets belong in the
    one-row-per-query form that ``write_result_map`` produces, or in ranking tables.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("query_id", "product_ids"))


def scan_result_rows(spark: SparkSession, path) -> DataFrame:
    """Result lists stored as one JSON row per query."""
    return spark.read.schema("query_id string, product_ids array<string>").json(path)


def _numbered_lines(spark, path):
    """Lines with their place in the input: file, start of the split, place inside the split."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return spark.read.text(path).select(place.alias("seq"), "value")


def string_or_list(value):
    """A JSON text that is a string or a list of strings, as a list."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.lit(None)).when(F.startswith(F.ltrim(value), F.lit("[")), listed).otherwise(F.array(value))


def scan_lookup_map(spark: SparkSession, path, category: str | None = None) -> DataFrame:
    """(raw, normalized list) of a lookup file; the last line of a repeated raw value counts."""
    rows = _numbered_lines(spark, path).select(
        "seq", F.from_json("value", "raw string, normalized string").alias("row")
    ).select("seq", "row.*").filter(F.col("raw").isNotNull())
    last = rows.groupBy("raw").agg(F.max_by("normalized", "seq").alias("normalized"))
    out = last.select("raw", string_or_list(F.col("normalized")).alias("normalized"))
    return out if category is None else out.select(F.lit(category).alias("category"), "raw", "normalized")


def scan_price_ranges(spark: SparkSession, path) -> DataFrame:
    """(product_class, price_min, price_max); the last line of a class counts."""
    rows = _numbered_lines(spark, path).select(
        "seq", F.from_json("value", "product_class string, price_min double, price_max double").alias("row")
    ).select("seq", "row.*").filter(F.col("product_class").isNotNull())
    return rows.groupBy("product_class").agg(F.max_by(F.struct("price_min", "price_max"), "seq").alias("r")).select("product_class", "r.*")


def scan_class_mapping(spark: SparkSession, path) -> DataFrame:
    """(product_class, product_class_fixed); the last line of a class counts."""
    rows = _numbered_lines(spark, path).select(
        "seq", F.from_json("value", "product_class string, product_class_fixed string").alias("row")
    ).select("seq", "row.*").filter(F.col("product_class").isNotNull())
    return rows.groupBy("product_class").agg(F.max_by("product_class_fixed", "seq").alias("product_class_fixed"))


def scan_feature_weights(spark: SparkSession, path):
    """(weights, thresholds): (feature_type, item, weight) with lower-cased items, and the rating
    thresholds (seq, name, low, high, multiplier) in file order.
    """
    rows = _numbered_lines(spark, path).select(
        "seq",
        F.from_json(
            "value", "feature_type string, weight double, items array<string>, rating_thresholds map<string, array<double>>"
        ).alias("row"),
    ).select("seq", "row.*")
    weights = (
        rows.filter(F.col("feature_type") != "rating_config")
        .select("feature_type", "seq", "weight", F.explode("items").alias("item"))
        .groupBy("feature_type", F.lower("item").alias("item"))
        .agg(F.max_by("weight", "seq").alias("weight"))
    )
    thresholds = (
        rows.filter(F.col("feature_type") == "rating_config")
        .select(F.posexplode(F.map_entries("rating_thresholds")).alias("seq", "e"))
        .select("seq", F.col("e.key").alias("name"), *[F.get("e.value", F.lit(i)).alias(n) for i, n in enumerate(("low", "high", "multiplier"))])
    )
    return weights, thresholds


def scan_embeddings(spark: SparkSession, path):
    """(rows, rejects): (product_id, vector, sparse, metadata) from lines with either sparse layout, and the lines that can't be read."""
    rows, rejects = scan_jsonl(spark, path, EMBEDDING_SCHEMA)
    sparse = F.struct(
        F.coalesce("sparse_embedding.indices", "sparse_embedding.dimensions").alias("indices"),
        F.col("sparse_embedding.values").alias("values"),
    )
    counted = F.col("metadata").withField("rating_count", F.col("metadata.rating_count").cast("bigint"))
    return rows.select(F.col("id").alias("product_id"), F.col("dense_embedding").alias("vector"), sparse.alias("sparse"), counted.alias("metadata")), rejects


def scan_rankings(spark: SparkSession, path) -> DataFrame:
    """Ranking rows (query_id, product_id, rank, query_type)."""
    return spark.read.schema(RANKING_SCHEMA).parquet(path)
