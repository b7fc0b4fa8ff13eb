"""Writers for the tables of the pipeline. Every writer leaves one folder of part files."""

from pyspark.sql import DataFrame, functions as F

from shelfrank.operators.retrieval import result_lists


def write_products(products: DataFrame, json_path: str, csv_path: str | None = None, mode: str = "errorifexists") -> None:
    """Final catalogue as JSON lines and, with lists as JSON text, as CSV."""
    products.write.mode(mode).json(json_path, ignoreNullFields=False)
    if csv_path:
        lists = {f.name: F.to_json(f.name) for f in products.schema.fields if f.dataType.typeName() == "array"}
        products.withColumns(lists).write.mode(mode).csv(
            csv_path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )


def write_profile(profile: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Class profile as JSON lines."""
    profile.write.mode(mode).json(path, ignoreNullFields=False)


def write_result_map(queries: DataFrame, hits: DataFrame, path: str, order: str = "position", mode: str = "errorifexists") -> None:
    """One JSON row per query with its ids in order; queries without hits keep an empty list."""
    result_lists(queries, hits, order).write.mode(mode).json(path)


def embedding_order():
    """Numeric suffix of the id where there is one, then the id text."""
    return [F.expr("try_cast(replace(id, 'product_', '') AS bigint)").asc_nulls_last(), F.col("id")]


def write_embeddings(embeddings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(id, dense_embedding, sparse_embedding, metadata) as JSON lines sorted over all part files."""
    embeddings.orderBy(*embedding_order()).write.mode(mode).json(path)


def write_queries(queries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Queries with their parameters nested; parameters that are not set are left out."""
    own = [c for c in ("query_id", "query_type", "query_text") if c in queries.columns]
    params = [c for c in queries.columns if c not in own]
    queries.select(*own, F.struct(*params).alias("query_params")).write.mode(mode).json(path)


def write_rankings(rankings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ranking rows as Parquet."""
    rankings.select("query_id", "product_id", F.col("rank").cast("int").alias("rank"), "query_type").write.mode(mode).parquet(path)
