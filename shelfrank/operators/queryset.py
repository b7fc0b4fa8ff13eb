"""Query generation from class profiles, validation by search, renumbering and reports.

All random choices are hash draws by (type, slot, attempt), so every attempt of every
slot is a row and the whole set is generated, searched and accepted in one job.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfrank.functions.draws import beta_1_3, beta_3_1, pick, uniform
from shelfrank.functions.lookup import small_side
from shelfrank.functions.ranking import top_k
from shelfrank.functions.text import collapse_spaces
from shelfrank.operators.profiling import most_common, value_counts
from shelfrank.session import materialize

N_CLASSES = 50
MAX_ATTEMPTS = 10
MIN_RESULTS = 15
TOP_K = 20
DEFAULT_STAT = 2.0
QUERY_TYPES = ("simple", "negation", "number", "complex")
EXPECTED = {t: 5 for t in QUERY_TYPES}
ATTRIBUTES = ("material", "color", "style")
STATS = ("rating", "rating_count", "price")
STAT_COLUMNS = {"rating": "average_rating", "rating_count": "rating_count", "price": "price"}
# Preference phrases per stat and the sign of the weight they set.
PHRASES = {
    "rating": ["top rated", "highly rated", "excellent"],
    "rating_count": ["super popular", "well known", "viral"],
    "price": ["affordable", "budget friendly", "cheap"],
}
PHRASE_WEIGHTS = {"rating": 1.0, "rating_count": 1.0, "price": -1.0}
TEXT_PARAMS = ("product_class", "product_description", "style", "color", "material", "style_negated", "color_negated", "material_negated")
NUMBER_PARAMS = ("rating_min", "rating_count_min", "price_max", "rating_weight", "rating_count_weight", "price_weight")


# ---------------------------------------------------------------- class profile


def top_classes(df: DataFrame, k: int = N_CLASSES) -> DataFrame:
    """Rows of the k most frequent classes."""
    kept = most_common(value_counts(df, "product_class"), k).select(F.col("value").alias("product_class"))
    return df.join(small_side(kept), "product_class", "left_semi")


def class_stats(df: DataFrame) -> DataFrame:
    """Smallest and largest rating, rating count and price per class, to 2 decimals."""
    ends = []
    for stat, column in STAT_COLUMNS.items():
        value = F.col(column).cast("double")
        ends += [F.round(F.min(value), 2).alias(f"{stat}_lo"), F.round(F.max(value), 2).alias(f"{stat}_hi")]
    return df.filter(F.col("product_class").isNotNull()).groupBy("product_class").agg(*ends)


def clean_category_value(value: Column) -> Column:
    """Lower-cased value without percentages and extra blanks."""
    return F.lower(collapse_spaces(F.regexp_replace(value, r"\d+\s*%", "")))


def class_values(df: DataFrame) -> DataFrame:
    """Distinct cleaned attribute values per class in long form: (product_class, attribute, value)."""
    lists = [
        F.struct(F.lit(a).alias("attribute"), (F.col(a) if df.schema[a].dataType.typeName() == "array" else F.split(a, ",")).alias("items"))
        for a in ATTRIBUTES
    ]
    return (
        df.filter(F.col("product_class").isNotNull())
        .select("product_class", F.explode(F.array(*lists)).alias("pair"))
        .select("product_class", "pair.attribute", F.explode("pair.items").alias("value"))
        .withColumn("value", clean_category_value(F.col("value")))
        .filter(F.col("value") != "")
        .distinct()
    )


def class_value_sets(df: DataFrame) -> DataFrame:
    """One row per class with the sorted distinct values of each attribute."""
    values = class_values(df)
    sets = [
        F.array_sort(F.collect_list(F.when(F.col("attribute") == a, F.col("value")))).alias(f"{a}s") for a in ATTRIBUTES
    ]
    return values.groupBy("product_class").agg(*sets)


def class_profile(df: DataFrame) -> DataFrame:
    """Value sets and stats of every class; a class without values has empty sets."""
    empty = F.array().cast("array<string>")
    profile = class_stats(df).join(class_value_sets(df), "product_class", "left")
    return profile.withColumns({f"{a}s": F.coalesce(f"{a}s", empty) for a in ATTRIBUTES})


# ---------------------------------------------------------------- draws


def draw_stat(stat: Column, low: Column, high: Column, u: Column) -> Column:
    """Skewed value between the ends: low ratings and counts and high prices are likelier; 0 for an unknown stat."""
    early, late = low + (high - low) * beta_1_3(u), low + (high - low) * beta_3_1(u)
    return (
        F.when(stat == "rating", F.round(early, 1))
        .when(stat == "rating_count", F.rint(early / 10) * 10)
        .when(stat == "price", F.rint(late / 10) * 10)
        .otherwise(F.lit(0.0))
    )


def draw_phrase(stat: Column, u: Column) -> Column:
    """Preference phrase of a stat; null for an unknown stat."""
    out = F.lit(None).cast("string")
    for name, phrases in PHRASES.items():
        out = F.when(stat == name, pick(F.array(*[F.lit(p) for p in phrases]), u)).otherwise(out)
    return out


def phrase_weight(stat: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in PHRASE_WEIGHTS.items():
        out = F.when(stat == name, F.lit(weight)).otherwise(out)
    return out


def draw_category_value(values: Column, u: Column) -> Column:
    """One value of a sorted set, never blank or 'unknown'; empty text when none is left."""
    usable = F.filter(values, lambda v: (v != "") & (F.lower(v) != "unknown"))
    return F.coalesce(pick(usable, u), F.lit(""))


def render_text(item: Column, category: Column, value: Column) -> Column:
    """``value item`` for materials and colours, ``item in value style`` for styles, in lower case."""
    item, value = F.lower(item), F.lower(value)
    return (
        F.when(category.isin("material", "color"), F.concat(value, F.lit(" "), item))
        .when(category == "style", F.concat(item, F.lit(" in "), value, F.lit(" style")))
        .otherwise(F.lit(""))
    )


# ---------------------------------------------------------------- generation


def _choose(names, u: Column) -> Column:
    return pick(F.array(*[F.lit(n) for n in names]), u)


def _by_name(name: Column, columns) -> Column:
    """Value of the column whose key equals ``name``."""
    out = None
    for key, column in columns.items():
        out = F.when(name == key, column) if out is None else out.when(name == key, column)
    return out


def _u(seed, tag):
    return uniform(seed, tag, "query_type", "slot", "attempt")


def _value_of(category: Column, seed, tag) -> Column:
    sets = _by_name(category, {a: F.col(f"{a}s") for a in ATTRIBUTES})
    return draw_category_value(sets, _u(seed, tag))


def _set_params(df: DataFrame, category: str, value: str, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{a}{suffix}": F.when(F.col(category) == a, F.col(value)) for a in ATTRIBUTES})


def _one_attribute(slots: DataFrame, seed: int, choices) -> DataFrame:
    item = F.col("product_class")
    df = slots.withColumn("category", _choose(choices, _u(seed, "category"))).withColumn("value", _value_of(F.col("category"), seed, "value"))
    return _set_params(df, "category", "value").withColumn("base_text", render_text(item, F.col("category"), F.col("value")))


def _finish(df: DataFrame, text: Column, description: Column) -> DataFrame:
    have = set(df.columns) - {"product_description"}

    def param(name, kind):
        column = description if name == "product_description" else F.col(name) if name in have else F.lit(None)
        return column.cast(kind).alias(name)

    texts, numbers = [param(p, "string") for p in TEXT_PARAMS], [param(p, "double") for p in NUMBER_PARAMS]
    query_id = F.format_string("%s-%03d", "query_type", "slot").alias("query_id")
    return cleanup_params(df.select(query_id, "query_type", "slot", "attempt", text.alias("query_text"), *texts, *numbers))


def gen_simple(slots: DataFrame, seed: int = 42) -> DataFrame:
    """One random attribute; the description is the text."""
    df = _one_attribute(slots, seed, ATTRIBUTES)
    return _finish(df, F.col("base_text"), F.col("base_text"))


def gen_negation(slots: DataFrame, seed: int = 42) -> DataFrame:
    """Two different attributes, one of them negated: its value moves to the negated parameter."""
    item = F.col("product_class")
    # The first of the pair is any of three, the second any of the two left.
    first = _choose(ATTRIBUTES, _u(seed, "first"))
    left = F.array_remove(F.array(*[F.lit(a) for a in ATTRIBUTES]), F.col("first"))
    df = slots.withColumn("first", first).withColumn("second", pick(left, _u(seed, "second")))
    df = df.withColumn("negate_first", _u(seed, "negated") < 0.5)
    for part in ("first", "second"):
        df = df.withColumn(f"{part}_value", _value_of(F.col(part), seed, f"{part}_value"))

    def shown(part, negated):
        value, category = F.col(f"{part}_value"), F.col(part)
        said_not = F.concat(F.lit("not "), value, F.lit(" "), category)
        return F.when(negated, said_not).otherwise(render_text(item, category, value))

    negated_first = F.col("negate_first")
    df = df.withColumn("base_text", F.concat(shown("first", negated_first), F.lit(", "), shown("second", ~negated_first)))
    df = df.withColumn("kept", F.when(negated_first, F.col("second")).otherwise(F.col("first")))
    df = df.withColumn("kept_value", F.when(negated_first, F.col("second_value")).otherwise(F.col("first_value")))
    df = df.withColumn("dropped", F.when(negated_first, F.col("first")).otherwise(F.col("second")))
    df = df.withColumn("dropped_value", F.when(negated_first, F.col("first_value")).otherwise(F.col("second_value")))
    df = _set_params(_set_params(df, "kept", "kept_value"), "dropped", "dropped_value", "_negated")
    return _finish(df, F.col("base_text"), F.col("base_text"))


def gen_number(slots: DataFrame, seed: int = 42) -> DataFrame:
    """One attribute and one bound; the description leaves the bound out."""
    df = _one_attribute(slots, seed, ATTRIBUTES).withColumn("stat", _choose(STATS, _u(seed, "stat")))
    low = _by_name(F.col("stat"), {s: F.col(f"{s}_lo") for s in STATS})
    high = _by_name(F.col("stat"), {s: F.col(f"{s}_hi") for s in STATS})
    bound = F.coalesce(draw_stat(F.col("stat"), low, high, _u(seed, "stat_value")), F.lit(DEFAULT_STAT))
    df = df.withColumn("bound", bound)
    whole = F.col("bound").cast("long").cast("string")
    suffix = (
        F.when(F.col("stat") == "rating", F.concat(F.lit(", with more than "), F.format_string("%.1f", "bound"), F.lit(" stars rating")))
        .when(F.col("stat") == "rating_count", F.concat(F.lit(", with more than "), whole, F.lit(" ratings")))
        .otherwise(F.concat(F.lit(", under $"), whole))
    )
    for stat, param in {"rating": "rating_min", "rating_count": "rating_count_min", "price": "price_max"}.items():
        df = df.withColumn(param, F.when(F.col("stat") == stat, F.col("bound")))
    return _finish(df, F.concat("base_text", suffix), F.col("base_text"))


def gen_complex(slots: DataFrame, seed: int = 42, rating_weight: str = "rating_weight") -> DataFrame:
    """A preference phrase before a colour or material; the matching weight is set."""
    df = _one_attribute(slots, seed, ("color", "material")).withColumn("stat", _choose(STATS, _u(seed, "stat")))
    for stat in STATS:
        df = df.withColumn(f"{stat}_weight", F.when(F.col("stat") == stat, phrase_weight(F.col("stat"))))
    phrase = draw_phrase(F.col("stat"), _u(seed, "phrase"))
    text = F.trim(F.concat(phrase, F.lit(" "), F.col("base_text")))
    done = _finish(df.withColumn("full_text", text), F.col("full_text"), F.col("full_text"))
    return done if rating_weight == "rating_weight" else done.withColumnRenamed("rating_weight", rating_weight)


GENERATORS = {"simple": gen_simple, "negation": gen_negation, "number": gen_number, "complex": gen_complex}


def query_slots(profile: DataFrame, counts=None, attempts: int = 1, seed: int = 42) -> DataFrame:
    """One row per (query_type, slot, attempt), each with a class picked evenly from the profile."""
    counts = counts or EXPECTED
    spark = profile.sparkSession
    types = spark.createDataFrame(list(counts.items()), "query_type string, slots int")
    rows = (
        types.filter("slots > 0")
        .select("query_type", F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"))
        .select("query_type", "slot", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    )
    # Classes were cut to the most frequent ones, so their list is short.
    names = profile.agg(F.array_sort(F.collect_list("product_class"))).scalar()
    picked = rows.withColumn("_classes", names).withColumn("product_class", pick(F.col("_classes"), _u(seed, "class")))
    return picked.drop("_classes").join(profile, "product_class")


def gen_queries(profile: DataFrame, counts=None, attempts: int = 1, seed: int = 42) -> DataFrame:
    """Queries of all types; ids are ``type-001`` and so on."""
    slots = query_slots(profile, counts, attempts, seed)
    out = None
    for query_type, generate in GENERATORS.items():
        part = generate(slots.filter(F.col("query_type") == query_type), seed)
        out = part if out is None else out.unionByName(part)
    return out


def cleanup_params(queries: DataFrame) -> DataFrame:
    """Empty texts, zeros and empty lists become null."""
    out = {}
    kinds = {f.name: f.dataType.typeName() for f in queries.schema.fields}
    for p in [p for p in TEXT_PARAMS + NUMBER_PARAMS if p in kinds]:
        kind = kinds[p]
        if kind == "array":
            out[p] = F.when(F.size(p) > 0, F.col(p))
        elif kind == "string":
            out[p] = F.nullif(F.col(p), F.lit(""))
        else:
            out[p] = F.when(F.col(p) != 0, F.col(p))
    return queries.withColumns(out)


# ---------------------------------------------------------------- validation


def validate_queries(attempts: DataFrame, search, targets=None, min_results: int = MIN_RESULTS):
    """Accepted queries and their hits.

    ``attempts`` has one row per (query_type, slot, attempt); ``search(queries)`` returns
    (query_id, product_id, position) for all of them at once. The first attempt of a slot
    with enough hits wins, then the first slots of each type up to its target. The
    attempts and their hits are both read more than once, so each is written out once.
    """
    targets = targets or EXPECTED
    keyed = materialize(
        attempts.withColumn("slot_id", F.col("query_id")).withColumn(
            "query_id", F.concat_ws("#", F.col("query_id"), F.col("attempt").cast("string"))
        )
    )
    hits = materialize(search(keyed))
    enough = hits.groupBy("query_id").agg(F.count("*").alias("n_hits")).filter(F.col("n_hits") >= min_results)
    passed = top_k(keyed.join(enough, "query_id"), ["slot_id"], ["attempt"], 1, "_first").drop("_first")
    wanted = F.create_map(*[x for t, n in targets.items() for x in (F.lit(t), F.lit(n))])
    place = F.row_number().over(Window.partitionBy("query_type").orderBy("slot"))
    accepted = passed.withColumn("_place", place).filter(F.col("_place") <= F.try_element_at(wanted, "query_type"))
    names = accepted.select("query_id", F.col("slot_id").alias("new_id"))
    chosen = hits.join(small_side(names), "query_id").select(F.col("new_id").alias("query_id"), "product_id", "position")
    queries = accepted.drop("query_id", "_place").withColumnRenamed("slot_id", "query_id")
    return queries.select(*[c for c in attempts.columns], "n_hits"), chosen


def renumber_queries(queries: DataFrame, results: DataFrame, max_count: int = 100):
    """Queries of each type in number order, at most ``max_count``, renumbered from 001; results follow."""
    number = F.try_element_at(F.split("query_id", "-"), F.lit(2)).cast("int")
    typed = queries.withColumn("_type", F.substring_index("query_id", "-", 1)).withColumn("_number", number)
    kept = top_k(typed, ["_type"], ["_number", "query_id"], max_count, "_place").withColumn(
        "new_id", F.format_string("%s-%03d", "_type", "_place")
    )
    moved = results.join(kept.select("query_id", "new_id"), "query_id").withColumn("query_id", F.col("new_id")).select(*results.columns)
    return kept.withColumn("query_id", F.col("new_id")).select(*queries.columns), moved


def join_synthetic(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Each query with its result list."""
    return queries.join(results, "query_id")


def type_breakdown(queries: DataFrame, expected=None) -> DataFrame:
    """Actual and expected count per type, how many are missing, and the share reached."""
    expected = expected or EXPECTED
    wanted = queries.sparkSession.createDataFrame(list(expected.items()), "query_type string, expected long")
    actual = queries.groupBy(F.coalesce("query_type", F.lit("unknown")).alias("query_type")).agg(F.count("*").alias("actual"))
    both = actual.join(wanted, "query_type", "full").fillna(0, ["actual", "expected"])
    return both.select(
        "query_type", "actual", "expected",
        F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).alias("missing"),
        F.when(F.col("expected") > 0, F.round(F.col("actual") / F.col("expected") * 100, 1)).alias("percent"),
    )


def distinct_param_names(params: DataFrame, column: str = "params") -> DataFrame:
    """Names in use over all parameter maps."""
    return params.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def scale_weights(queries: DataFrame, factor: float = 0.5) -> DataFrame:
    """Multiply every parameter whose name contains 'weight'."""
    return queries.withColumns({c: F.col(c) * factor for c in queries.columns if "weight" in c})
