"""Sparse term weights and exact text search over one or several fields."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.functions.lookup import MAX_BROADCAST_ROWS, as_map, fits_inline, small_side
from shelfrank.functions.ranking import top_k
from shelfrank.functions.text import explode_tokens, term_counts, token_count, tokens
from shelfrank.operators.filters import LIST_ATTRIBUTES, LIST_PARAMS, RANGE_PARAMS, RANGES, match_condition, prepare_params
from shelfrank.session import materialize


# Fixed values of the term weight.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 9
# Field priority: title before content before keywords.
FIELD_BOOSTS = {"product_name": 3.0, "product_description": 2.0, "product_class": 2.0, "material": 1.0, "style": 1.0, "color": 1.0}


def product_text(df: DataFrame, out: str = "text") -> DataFrame:
    """Class in capitals, name and description as one labelled text; nulls print as nothing."""

    def shown(label, c):
        return F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))

    return df.withColumn(
        out,
        F.concat_ws(
            " | ",
            shown("product_class", F.upper("product_class")),
            shown("product_name", F.col("product_name")),
            shown("product_description", F.col("product_description")),
        ),
    )


def query_text_expand(df: DataFrame, text: str = "query_text", out: str = "search_text") -> DataFrame:
    """Query text followed by the class in capitals where the query names one; empty parts vanish."""
    named = F.when(F.col("product_class") != "", F.concat(F.lit("product_class: "), F.upper("product_class")))
    return df.withColumn(out, F.concat_ws(" | ", F.when(F.col(text) != "", F.col(text)), named))


def term_weight(tf: Column, df: Column, length: Column, mean_length: Column, docs: Column) -> Column:
    """Saturated, length-normalised term frequency times inverse document frequency."""
    idf = F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))




def sparse_vectors(texts: DataFrame, key: str = "product_id") -> DataFrame:
    """Weight of every term of every document in long form: (key, term, tf, weight).

    Texts are cut into words once: each row's counts are written, one row a text. Only where a key stands twice with texts of one
    length its counts are summed by an exchange. The terms' document counts are written next. A vocabulary of checked size goes to the documents' words, which then are not
    shuffled; a larger one is a plain join of two exchanges, where the optimizer splits a word found in every document.
    """
    words = texts.select(key, tokens(F.col("text")).alias("words"))
    parts = materialize(words.select(key, F.size("words").alias("length"), term_counts(F.col("words")).alias("counts")))
    stats = parts.agg(F.struct(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))).scalar()
    counted = parts.select(key, "length", explode_tokens(F.col("counts")).alias("c")).filter(F.col("c").isNotNull()).select(key, "length", "c.term", "c.tf")
    if not parts.groupBy(key, "length").count().filter("count > 1").isEmpty():
        counted = counted.groupBy(key, "length", "term").agg(F.sum("tf").alias("tf"))
    spread = materialize(counted.groupBy("term").agg(F.count("*").alias("df")))
    return (
        counted.join(small_side(spread), "term")
        .withColumn("stats", stats)
        .select(
            key, "term", "tf",
            term_weight(F.col("tf"), F.col("df"), F.col("length"), F.col("stats.mean_length"), F.col("stats.docs")).alias("weight"),
        )
    )


def query_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, term, qtf) of every query."""
    return (
        queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def few_words(queries: DataFrame, text: str, limit: int) -> bool:
    """True when the queries have at most ``limit`` words, repeats included; reads no more than that."""
    return fits_inline(queries.select(F.explode(tokens(F.col(text)))), limit)


def word_sets(terms: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, members): the distinct sets of known words and counts as queries of their own, and (query_id, word_set) of every query.

    Words no document holds add nothing to a score, so queries that differ only in these have the same rows.
    """
    held = terms.join(small_side(known), "term", "left_semi")
    asked = materialize(held.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("words")))
    sets = materialize(asked.select("words").distinct().withColumn("word_set", F.monotonically_increasing_id()))
    members = asked.join(small_side(sets), "words").select("query_id", "word_set")
    return sets.select(F.col("word_set").alias("query_id"), F.explode("words").alias("w")).select("query_id", "w.term", "w.qtf"), members


def for_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """The rows found for word sets, for every query that asks for them."""
    found = materialize(found.withColumnRenamed("query_id", "word_set"))
    return members.join(small_side(found), "word_set").select("query_id", "product_id", "score", "position")


def by_document(df: DataFrame) -> DataFrame:
    """Partition by document in as many parts as the session shuffles into.

    The number is given explicitly because what follows grows the rows: merging small
    partitions here, as the optimizer otherwise would, leaves too few tasks for it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "product_id")


def asked_weights(texts: DataFrame, terms: DataFrame, send) -> DataFrame:
    """(product_id, term, weight) of the words some query asks for, summed over fields; ``send`` marks tables of checked size for broadcast.

    Texts are partitioned by document before they are cut into words, once; equal rows are summed there. What is
    asked for is written as one row a text, its words as one text, so frequencies and weights do not read the texts again.
    """
    vocabulary = terms.select("term").distinct()
    row = ["product_id", "field", "boost", "length"]
    words = by_document(texts.select("product_id", "field", "boost", "text")).select("product_id", "field", "boost", tokens(F.col("text")).alias("words"))
    found = words.select("product_id", "field", "boost", F.size("words").alias("length"), explode_tokens(F.col("words")).alias("term")).join(send(vocabulary), "term", "left_semi")
    counts = found.groupBy(*row, "term").agg(F.count("*").alias("tf")).groupBy(*row).agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    # Words are letters and digits, so a blank parts them again.
    texts_of = materialize(counts.select(*row, F.array_join("c.term", " ").alias("term"), F.col("c.tf").cast("array<int>").alias("tf")))
    entries = F.arrays_zip(F.split("term", " ").alias("term"), F.col("tf").alias("tf"))

    def unpacked(rows):
        return rows.select(*row, F.explode(entries).alias("e")).select(*row, "e.term", "e.tf")

    # About as large as the vocabulary.
    spread = materialize(unpacked(texts_of).groupBy("field", "term").agg(F.count("*").alias("df")))
    # One entry per field, of which there are a handful.
    lengths = as_map(
        texts.groupBy("field").agg(F.struct(F.count("*").alias("docs"), F.avg(token_count(F.col("text"))).alias("mean_length")).alias("stats")),
        "field", "stats",
    )
    stats = F.col("lengths")[F.col("field")]
    weight = term_weight(F.col("tf"), F.col("df"), F.col("length"), stats.mean_length, stats.docs)
    return (
        unpacked(by_document(texts_of)).join(send(spread), ["field", "term"])
        .withColumn("lengths", lengths)
        .groupBy("product_id", "term")
        .agg(F.sum(F.col("boost") * weight).alias("weight"))
    )


def search_texts(texts: DataFrame, queries: DataFrame, n: int, text: str = "query_text", products: DataFrame | None = None,
                 absent: str = "positive", max_terms: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """n best documents per query by summed term weights: (query_id, product_id, score, position).

    ``texts`` has product_id, field, boost, text: statistics are per field, scores add
    up over fields. With ``products`` the per-query conditions apply before the cut.

    Words no query asks for are dropped where the texts are cut into words. What is left is
    partitioned by document; weights, conditions and scores are then all computed inside
    that partitioning, and each task passes on n rows per query. A term found in most
    documents therefore never moves its document-query pairs over the network.

    Of a query set with more than ``max_terms`` words, queries that ask for the same known words are searched
    once, unless each has conditions of its own. What is left beyond ``max_terms`` rows is searched in blocks of
    about that size over the same written document weights.
    """
    terms = query_terms(queries, text)
    small = few_words(queries, text, max_terms)
    asked_words = terms if small else materialize(terms.select("term").distinct())
    send = F.broadcast if small or fits_inline(asked_words, MAX_BROADCAST_ROWS) else (lambda table: table)
    weighted = asked_weights(texts, asked_words, send)
    members = None
    if not small:
        weighted = materialize(weighted)
        if products is None:
            terms, members = word_sets(terms, weighted.select("term").distinct())
        weighted = by_document(weighted)
    if products is not None:
        attributes = F.struct(*LIST_ATTRIBUTES, *[r[0] for r in RANGES]).alias("p")
        weighted = weighted.join(products.select("product_id", attributes), "product_id")
        params = F.struct(*LIST_PARAMS, *RANGE_PARAMS).alias("q")
        terms = terms.join(prepare_params(queries, absent).select("query_id", params), "query_id")

    def best(asked):
        matches = weighted.join(F.broadcast(asked), "term")
        if products is not None:
            matches = matches.filter(match_condition(lambda c: F.col(f"p.{c}"), lambda c: F.col(f"q.{c}")))
        scores = matches.groupBy("query_id", "product_id").agg(
            F.round(F.sum(F.col("qtf") * F.col("weight")), SCORE_DIGITS).alias("score")
        )
        return top_k(scores, ["query_id"], [F.desc("score"), "product_id"], n)

    if small:
        return best(terms)
    terms = materialize(terms)
    blocks = max(1, -(-terms.count() // max_terms))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [best(terms.filter(block == i)) for i in range(blocks)])
    return found if members is None else for_members(found, members)


def one_field(df: DataFrame, column: str = "text") -> DataFrame:
    return df.select("product_id", F.lit("text").alias("field"), F.lit(1.0).alias("boost"), F.col(column).alias("text"))


def sparse_topk(texts: DataFrame, queries: DataFrame, n: int = 120, text: str = "query_text", products: DataFrame | None = None, absent: str = "positive") -> DataFrame:
    """Top-n per query by the inner product of query term counts and document term weights."""
    return search_texts(one_field(texts), queries, n, text, products, absent)


def sparse_dot_topk(postings: DataFrame, query_postings: DataFrame, n: int = 120) -> DataFrame:
    """Top-n per query of stored sparse vectors in long form: (product_id, term, weight) x (query_id, term, weight)."""
    wanted = query_postings.select("query_id", "term", F.col("weight").alias("query_weight"))
    # The small side meets the postings inside their document partitions.
    scores = (
        by_document(postings.join(wanted.select("term").distinct(), "term", "left_semi"))
        .join(small_side(wanted), "term")
        .groupBy("query_id", "product_id")
        .agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), SCORE_DIGITS).alias("score"))
    )
    return top_k(scores, ["query_id"], [F.desc("score"), "product_id"], n)


def explode_sparse(df: DataFrame, key: str, column: str = "sparse") -> DataFrame:
    """struct(indices, values) to long form (key, term, weight)."""
    cells = F.arrays_zip(F.col(f"{column}.indices").alias("term"), F.col(f"{column}.values").alias("weight"))
    return df.select(key, F.explode(cells).alias("cell")).select(key, "cell.term", "cell.weight")


def fielded_search(products: DataFrame, queries: DataFrame, k: int = 10, text: str = "query_text", boosts=None, absent: str = "positive", filtered: bool = True) -> DataFrame:
    """Full-text search over the product fields under the query conditions."""
    boosts = boosts or FIELD_BOOSTS
    fields = []
    for name, boost in boosts.items():
        is_list = products.schema[name].dataType.typeName() == "array"
        value = F.array_join(name, " ") if is_list else F.col(name)
        fields.append(F.struct(F.lit(name).alias("field"), F.lit(float(boost)).alias("boost"), value.alias("text")))
    texts = products.select("product_id", F.explode(F.array(*fields)).alias("f")).select("product_id", "f.*")
    return search_texts(texts, queries, k, text, products if filtered else None, absent)


def baseline_search(products: DataFrame, queries: DataFrame, columns, k: int = 10, text: str = "query_text") -> DataFrame:
    """One text similarity over the whole row printed as text."""
    from shelfrank.operators.catalog import stringify_row

    return sparse_topk(stringify_row(products, columns, "text"), queries, k, text)
