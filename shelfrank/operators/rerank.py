"""Reranking of candidate lists against the query text."""

from pyspark.sql import DataFrame, functions as F

from shelfrank.functions.ranking import top_k
from shelfrank.functions.text import tokens
from shelfrank.operators.retrieval import result_lists

RERANK_K = 10


def rerank_content(candidates: DataFrame, products: DataFrame, layout: str = "pipes") -> DataFrame:
    """Add title and content text to (query_id, product_id, rank) rows; unknown products are dropped.

    ``pipes`` prints one line with missing numbers as 0, ``lines`` one line per part with
    missing numbers as N/A and the rating count in brackets.
    """
    if layout not in ("pipes", "lines"):
        raise ValueError("layout must be 'pipes' or 'lines'")
    missing = "0" if layout == "pipes" else "N/A"

    def number(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(missing))

    def labelled(label, value):
        return F.concat(F.lit(f"{label}: "), value)

    lists = [
        labelled(label, F.coalesce(F.array_join(c, ", "), F.lit("")))
        for label, c in (("Colors", "color"), ("Materials", "material"), ("Styles", "style"), ("Country", "countryoforigin"))
    ]
    head = [F.coalesce("product_description", F.lit("")), labelled("Category", F.coalesce("product_class", F.lit(""))), F.concat(F.lit("Price: $"), number("price"))]
    if layout == "pipes":
        ratings = [labelled("Rating", number("average_rating")), labelled("Rating Count", number("rating_count"))]
    else:
        ratings = [F.concat(F.lit("Rating: "), number("average_rating"), F.lit(" ("), number("rating_count"), F.lit(" reviews)"))]
    content = F.concat_ws(" | " if layout == "pipes" else "\n", *head, *ratings, *lists)
    shown = products.select("product_id", F.coalesce("product_name", F.lit("")).alias("title"), content.alias("content"))
    return candidates.join(shown, "product_id")


def rerank_topn(queries: DataFrame, candidates: DataFrame, products: DataFrame, k: int = RERANK_K, layout: str = "pipes") -> DataFrame:
    """The k candidates whose title and content hold most of the query's words, ranked from 1.

    Equal scores keep the order they came in. A query without words keeps its order and
    scores 1.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("words"))
    held = F.array_distinct(F.concat(tokens(F.col("title")), tokens(F.col("content"))))
    share = F.size(F.array_intersect("words", held)) / F.size("words")
    scored = (
        rerank_content(candidates, products, layout)
        .join(asked, "query_id")
        .withColumn("score", F.when(F.size("words") > 0, F.round(share, 9)).otherwise(F.lit(1.0)))
        .select("query_id", "product_id", "title", "score", F.col("rank").alias("first_rank"))
    )
    return top_k(scored, ["query_id"], [F.desc("score"), "first_rank", "product_id"], k, "rank")


def rerank_batch(queries: DataFrame, result_map: DataFrame, products: DataFrame, k: int = RERANK_K, layout: str = "pipes") -> DataFrame:
    """Reranked lists of all queries that have a result list; an empty list stays empty."""
    both = queries.join(result_map.select("query_id", "product_ids"), "query_id")
    candidates = both.select("query_id", F.posexplode("product_ids").alias("pos", "product_id")).select(
        "query_id", "product_id", (F.col("pos") + 1).alias("rank")
    )
    ranked = rerank_topn(both, candidates, products, k, layout)
    return result_lists(both, ranked, "rank")
