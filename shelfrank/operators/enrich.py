"""Query enrichment: class descriptions and terms, response parsing, parameter extraction, acceptance."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.functions.draws import pick, uniform
from shelfrank.functions.lookup import small_side
from shelfrank.functions.ranking import top_k
from shelfrank.functions.text import bigrams, collapse_spaces, explode_tokens, strip, tokens
from shelfrank.session import materialize

MAX_DESCRIPTIONS = 10
MIN_RESULTS = 15
MAX_TERMS = 8
# The six lists of a feature response.
FEATURE_TYPES = (
    "FUNCTIONAL_FEATURES", "USAGE_CONTEXTS", "SIZE_DESCRIPTORS",
    "EMOTIONAL_DESCRIPTORS", "CONSTRUCTION_FEATURES", "BENEFIT_PHRASES",
)
# What a failed parameter response is replaced with.
EMPTY_RESPONSE = "Empty response from LLM"
NOT_A_DICTIONARY = "Response is not a valid dictionary"
INVALID_JSON = "Failed to parse JSON"
RESPONSE_LISTS = ("color", "material", "style", "color_negated", "material_negated", "style_negated")
RESPONSE_TEXTS = ("product_class", "product_description")
RESPONSE_NUMBERS = ("price_max", "rating_min", "rating_count_min")


# ---------------------------------------------------------------- classes


def group_by_class(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Non-synthetic queries that name a class and have a result list: (product_class, query_id, class_queries)."""
    usable = (
        queries.filter((F.coalesce("query_type", F.lit("")) != "synth") & (F.col("product_class") != ""))
        .join(results.select("query_id").distinct(), "query_id", "left_semi")
        .select("product_class", "query_id")
    )
    return usable.join(usable.groupBy("product_class").agg(F.count("*").alias("class_queries")), "product_class")


def class_descriptions(grouped: DataFrame, hits: DataFrame, products: DataFrame, k: int = MAX_DESCRIPTIONS) -> DataFrame:
    """The k longest distinct descriptions of the products each class's queries found.

    Products are made distinct per class before their texts are fetched, and equal texts
    are found by digest.
    """
    found = grouped.join(hits.select("query_id", "product_id"), "query_id").select("product_class", "product_id").distinct()
    texts = found.join(products.filter(F.col("product_description").isNotNull()).select("product_id", "product_description"), "product_id")
    distinct = texts.groupBy("product_class", F.sha2("product_description", 256).alias("digest")).agg(
        F.any_value("product_description").alias("product_description")
    )
    order = [F.desc(F.length("product_description")), "product_description"]
    return top_k(distinct, ["product_class"], order, k).select("product_class", "position", "product_description")


def mine_class_terms(texts: DataFrame, vocabulary: DataFrame, k: int = MAX_TERMS, min_count: int = 2, min_length: int = 1) -> DataFrame:
    """Up to k one- or two-word phrases that are common in a class and rare elsewhere.

    ``texts`` has (product_class, text); phrases in ``vocabulary`` (value) are left out.
    A phrase counts once per text and must occur in at least ``min_count`` texts of the
    class; the score is that count times the log of all texts over texts holding it.
    """
    words = tokens(F.col("text"))
    parts = texts.select("product_class", words.alias("words")).select(
        "product_class", F.array_distinct(F.concat("words", bigrams(F.col("words")))).alias("phrases")
    )
    per_class = (
        parts.select("product_class", explode_tokens(F.col("phrases")).alias("term"))
        .filter(F.length("term") >= min_length)
        .groupBy("product_class", "term")
        .agg(F.count("*").alias("df"))
    )
    total = texts.agg(F.count("*")).scalar()
    # A term has one row per class here, so the window holds no more rows than there are classes.
    scored = (
        per_class.withColumn("df_all", F.sum("df").over(Window.partitionBy("term")))
        .filter(F.col("df") >= min_count)
        .join(vocabulary.select(F.lower("value").alias("term")), "term", "left_anti")
        .withColumn("score", F.round(F.col("df") * F.log(total / F.col("df_all")), 9))
    )
    return top_k(scored, ["product_class"], [F.desc("score"), "term"], k).select("product_class", "position", "term", "df", "score")


# ---------------------------------------------------------------- responses


def strip_code_fence(text: Column) -> Column:
    """Text without an opening fence line and a closing fence."""
    opened = F.regexp_replace(strip(text), r"^```[^\n]*\n", "")
    return strip(F.regexp_replace(F.regexp_replace(opened, r"^```", ""), r"```$", ""))


def parse_feature_response(responses: DataFrame, text: str = "response_text") -> DataFrame:
    """Add the six feature lists; missing or non-list entries and unreadable responses give empty lists."""
    parsed = responses.withColumn("_json", F.try_parse_json(strip_code_fence(F.col(text))))
    empty = F.array().cast("array<string>")
    lists = {t: F.coalesce(F.try_variant_get("_json", f"$.{t}", "array<string>"), empty) for t in FEATURE_TYPES}
    return parsed.withColumns(lists).drop("_json")


def clean_json_response(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(json)?", ""), r"```$", ""))


def parse_param_response(responses: DataFrame, text: str = "response_text") -> DataFrame:
    """Add parameter columns and ``error``: null for a good response or for none at all.

    No response keeps the defaults (no parameters); a response that is empty between its
    fences, not JSON, or not an object yields its error instead of parameters.
    """
    answer = F.coalesce(strip(F.col(text)), F.lit(""))
    body = clean_json_response(answer)
    parsed = responses.withColumn("_body", body).withColumn("_json", F.try_parse_json("_body"))
    is_object = F.startswith(F.schema_of_variant("_json"), F.lit("OBJECT"))
    parsed = parsed.withColumn(
        "error",
        F.when(answer == "", F.lit(None).cast("string"))
        .when(F.col("_body") == "", F.lit(EMPTY_RESPONSE))
        .when(F.col("_json").isNull(), F.lit(INVALID_JSON))
        .when(~is_object, F.lit(NOT_A_DICTIONARY)),
    )

    def get(name, kind):
        return F.try_variant_get("_json", f"$.{name}", kind)

    out = {}
    for name in RESPONSE_LISTS:
        one = F.when(get(name, "string").isNotNull(), F.array(get(name, "string")))
        out[name] = F.coalesce(get(name, "array<string>"), one)
    out |= {name: get(name, "string") for name in RESPONSE_TEXTS}
    out |= {name: get(name, "double") for name in RESPONSE_NUMBERS}
    return parsed.withColumns(out).drop("_body", "_json")


def split_responses(parsed: DataFrame):
    """(usable rows, rejected rows)."""
    return parsed.filter(F.col("error").isNull()), parsed.filter(F.col("error").isNotNull())


# ---------------------------------------------------------------- parameters from text

PRICE_PATTERN = r"under \$?(\d+(?:\.\d+)?)"
STARS_PATTERN = r"more than (\d+(?:\.\d+)?) stars"
RATINGS_PATTERN = r"more than (\d+(?:\.\d+)?) ratings"
CONSTRAINT_PATTERN = r",?\s*(?:with )?(?:more than \d+(?:\.\d+)? (?:stars rating|stars|ratings)|under \$?\d+(?:\.\d+)?)"


def prompt_vocab(products: DataFrame) -> DataFrame:
    """Distinct colours, materials, styles and classes: (category, value)."""
    from shelfrank.operators.catalog import unique_categories

    return unique_categories(products)


def _number(text, pattern):
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def extract_params(queries: DataFrame, vocabulary: DataFrame, text: str = "query_text") -> DataFrame:
    """Parameters read from the query text: (query_id, lists, class, bounds, description).

    Vocabulary values of any length are met in one pass: every word of a query asks for the values that start
    with it and the word behind it, and what meets is compared in full. The work grows with the words and the matches, not with
    the longest value. A value right after "not" is negated, the longest class named wins, bounds come from the fixed phrases.
    """
    parts = tokens(F.col("value"))
    phrases = vocabulary.select("category", "value", F.array_join(parts, " ").alias("phrase"), F.size(parts).alias("length"), F.array_join(F.slice(parts, 1, 2), " ").alias("key"))
    phrases = materialize(phrases.filter("phrase != ''"))
    lowered = queries.select("query_id", F.lower(text).alias("t"), F.col(text).alias("raw"))
    words = lowered.select("query_id", tokens(F.col("t")).alias("words")).filter(F.size("words") > 0)
    starts = F.transform(
        "words",
        lambda w, i: F.struct(
            (i + 1).alias("start"), F.array_distinct(F.array(w, F.concat_ws(" ", w, F.get("words", i + 1)))).alias("keys"),
            F.coalesce(F.get("words", i - 1) == "not", F.lit(False)).alias("negated"),
        ),
    )
    asked = words.select("query_id", F.explode(starts).alias("s")).select("query_id", "s.start", "s.negated", F.explode("s.keys").alias("key"))
    met = asked.join(small_side(phrases), "key")
    # The first two words are equal by the key; only longer values are compared with the text again.
    longer = met.filter("length > 2").join(words, "query_id").filter(F.array_join(F.slice("words", F.col("start"), F.col("length")), " ") == F.col("phrase")).drop("words")
    found = met.filter("length <= 2").unionByName(longer)
    # A query is short, so the lists per query are too.
    def listed(category, negated):
        mine = (F.col("category") == category) & (F.col("negated") == negated)
        ordered = F.array_sort(F.collect_list(F.when(mine, F.struct("start", "length", "value"))))
        values = F.array_distinct(F.transform(ordered, lambda s: s.value))
        return F.when(F.size(values) > 0, values)

    is_class = (F.col("category") == "product_class") & ~F.col("negated")
    lists = {f"{c}{'_negated' if neg else ''}": listed(c, neg) for neg in (False, True) for c in ("color", "material", "style")}
    per_query = found.groupBy("query_id").agg(
        *[column.alias(name) for name, column in lists.items()],
        F.max(F.when(is_class, F.struct(F.length("phrase").alias("l"), (-F.col("start")).alias("s"), "value"))).value.alias("product_class"),
    )
    return lowered.join(per_query, "query_id", "left").select(
        "query_id", *lists, "product_class",
        _number("t", PRICE_PATTERN).alias("price_max"),
        _number("t", STARS_PATTERN).alias("rating_min"),
        _number("t", RATINGS_PATTERN).alias("rating_count_min"),
        collapse_spaces(F.regexp_replace("raw", CONSTRAINT_PATTERN, "")).alias("product_description"),
    )


# ---------------------------------------------------------------- enrichment


def enrich_queries(queries: DataFrame, features: DataFrame, seed: int = 42) -> DataFrame:
    """Add one drawn feature term to the text of every query whose class has features.

    Usage contexts follow the text, all other terms lead it; the description becomes the
    new text. Synthetic queries and queries of classes without a feature row are left out;
    a class whose lists are all empty leaves its queries unchanged.
    """
    lists = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("terms")) for t in FEATURE_TYPES])
    keep = queries.columns
    df = (
        queries.filter(F.coalesce("query_type", F.lit("")) != "synth")
        .join(features.select("product_class", *FEATURE_TYPES), "product_class")
        .withColumn("_lists", F.filter(lists, lambda s: F.coalesce(F.size(s.terms), F.lit(0)) > 0))
        .withColumn("_list", pick(F.col("_lists"), uniform(seed, "feature", "query_id")))
        .withColumn("_term", pick(F.col("_list.terms"), uniform(seed, "term", "query_id")))
    )
    text = (
        F.when(F.col("_term").isNull(), F.col("query_text"))
        .when(F.col("_list.type") == "USAGE_CONTEXTS", F.concat("query_text", F.lit(", for "), "_term"))
        .otherwise(F.concat("_term", F.lit(" "), "query_text"))
    )
    df = df.withColumn("_text", text)
    described = F.when(F.col("_term").isNull(), F.col("product_description")).otherwise(F.col("_text"))
    return df.withColumn("query_text", F.col("_text")).withColumn("product_description", described).select(*keep)


def accept_enriched(originals: DataFrame, enriched: DataFrame, hits: DataFrame, min_results: int = MIN_RESULTS):
    """Enriched queries with enough hits, the others back to their original text with no results.

    Returns the queries and the hits that stay. The list of queries with enough hits is
    written once, so the search behind ``hits`` runs for it and for the hits alone.
    """
    enough = materialize(hits.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_results).select("query_id"))
    new = enriched.join(enough, "query_id", "left_semi").withColumn("accepted", F.lit(True))
    waiting = enriched.select("query_id").join(enough, "query_id", "left_anti")
    old = originals.join(waiting, "query_id", "left_semi").withColumn("accepted", F.lit(False))
    return new.unionByName(old), hits.join(enough, "query_id", "left_semi")


def append_synth(queries: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Synthetic rows after the others, columns by name."""
    return queries.unionByName(synthetic, allowMissingColumns=True)
