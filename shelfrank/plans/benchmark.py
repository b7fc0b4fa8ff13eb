"""Query set, enrichment, ground truth and evaluation, each as one batch job."""

from pyspark.sql import DataFrame, functions as F

from shelfrank.operators import enrich as en, queryset as qs
from shelfrank.operators.evaluate import evaluate_rankings, format_rankings
from shelfrank.operators.rerank import rerank_batch
from shelfrank.operators.retrieval import result_lists
from shelfrank.operators.textsearch import fielded_search
from shelfrank.session import materialize


def text_search(products: DataFrame, k: int = qs.TOP_K, text: str = "product_description"):
    """Search function over the product fields; another search, such as the hybrid one, can take its place."""

    def search(queries: DataFrame) -> DataFrame:
        return fielded_search(products, queries, k, text).select("query_id", "product_id", "position")

    return search


def build_query_set(products: DataFrame, search=None, targets=None, attempts: int = qs.MAX_ATTEMPTS, min_results: int = qs.MIN_RESULTS, seed: int = 42):
    """(queries, hits): validated queries of every type, numbered from 001, and their results.

    Every type gets ten times its target in slots and every slot several attempts; all of
    them are generated and searched together.
    """
    targets = targets or qs.EXPECTED
    search = search or text_search(products)
    profile = materialize(qs.class_profile(qs.top_classes(products)))
    slots = {t: n * qs.MAX_ATTEMPTS for t, n in targets.items()}
    queries, hits = qs.validate_queries(qs.gen_queries(profile, slots, attempts, seed), search, targets, min_results)
    return qs.renumber_queries(queries.drop("slot", "attempt", "n_hits"), hits)


def enrich_query_set(queries: DataFrame, hits: DataFrame, products: DataFrame, features: DataFrame, search=None, min_results: int = qs.MIN_RESULTS, seed: int = 42):
    """(queries, hits) after adding feature terms and searching again; failed ones keep their text and lose their hits."""
    search = search or text_search(products)
    grouped = en.group_by_class(queries, hits)
    asked = queries.join(grouped.select("query_id"), "query_id", "left_semi")
    enriched = materialize(en.enrich_queries(asked, features, seed))
    return en.accept_enriched(asked, enriched, materialize(search(enriched)), min_results)


def response_features(responses: DataFrame) -> DataFrame:
    """Feature lists per class from model answers (product_class, response_text), all six types."""
    return en.parse_feature_response(responses).select("product_class", *en.FEATURE_TYPES)


def add_synthetic(queries: DataFrame, truth: DataFrame, synthetic: DataFrame, synthetic_lists: DataFrame):
    """(queries, truth) with the hand-made queries and their given result lists after the others; those without a list stay out."""
    given = qs.join_synthetic(synthetic, synthetic_lists)
    return en.append_synth(queries, given.drop("product_ids")), truth.unionByName(given.select("query_id", "product_ids"))


def mined_features(queries: DataFrame, hits: DataFrame, products: DataFrame) -> DataFrame:
    """Feature lists per class from the descriptions its queries found: one list of mined phrases, five empty ones."""
    texts = en.class_descriptions(en.group_by_class(queries, hits), hits, products).withColumnRenamed("product_description", "text")
    vocabulary = en.prompt_vocab(products).select("value").distinct()
    terms = en.mine_class_terms(materialize(texts), vocabulary)
    listed = terms.groupBy("product_class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda t: t.term).alias(en.FEATURE_TYPES[0])
    )
    return listed.withColumns({t: F.array().cast("array<string>") for t in en.FEATURE_TYPES[1:]})


def build_ground_truth(queries: DataFrame, hits: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Reranked result list of every query: (query_id, product_ids)."""
    return rerank_batch(queries, result_lists(queries, hits), products, k)


def evaluate_systems(systems, truth_lists: DataFrame, k: int = 10):
    """(report per system and type, report per query) for ``systems``: name -> (query_id, product_ids)."""
    predictions = None
    for name, lists in systems.items():
        rows = format_rankings(lists).withColumn("system", F.lit(name))
        predictions = rows if predictions is None else predictions.unionByName(rows)
    return evaluate_rankings(predictions, format_rankings(truth_lists, ground_truth=True), k)
