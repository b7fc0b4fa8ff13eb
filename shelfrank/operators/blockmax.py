"""Exact term search that leaves out blocks of documents which cannot reach a query's n-th score.

Documents with like words lie in blocks together. Of every block and term the largest weight is kept, so
the sum over a query's terms bounds the score of each document of the block. The blocks with the highest bounds are
scored first; the n-th score found there is a floor, and of the other blocks only those whose bound reaches it are
scored. All query words are rows of the same plan, whatever their number.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from shelfrank.functions.lookup import MAX_BROADCAST_ROWS, fits_inline, small_side
from shelfrank.functions.ranking import top_k
from shelfrank.operators.catalog import assign_dense_ids
from shelfrank.operators.filters import LIST_ATTRIBUTES, LIST_PARAMS, RANGE_PARAMS, RANGES, match_condition, prepare_params
from shelfrank.operators.textsearch import SCORE_DIGITS, asked_weights, few_words, for_members, one_field, query_terms, word_sets
from shelfrank.session import materialize

BLOCK = 32
DOCUMENTS_A_PART = 8192
MAX_SLOTS = 16384


class Bounded(NamedTuple):
    """What a bounded search looked at: (query_id, block, bound) of all blocks that share a word, the blocks scored first and then, and the scores."""

    bounds: DataFrame
    first: DataFrame
    then: DataFrame
    scores: DataFrame


def by_block(df: DataFrame, parts: int) -> DataFrame:
    """Partition by block. Two tables dealt into equally many parts meet on the block without another exchange."""
    return df.repartition(parts, "block")


def blocked(weighted: DataFrame, block: int = BLOCK) -> DataFrame:
    """``weighted`` with ``block``: documents in the order of their smallest word hash, which documents with like words often share."""
    return unpacked(blocked_documents(weighted, block))


def unpacked(documents: DataFrame) -> DataFrame:
    entries = F.arrays_zip(F.split("terms", " ").alias("term"), F.col("weights").alias("weight"))
    return documents.select("block", "product_id", F.explode(entries).alias("e")).select("block", "product_id", "e.term", "e.weight")


def blocked_documents(weighted: DataFrame, block: int) -> DataFrame:
    """One written row (block, product_id, terms, weights) a document, its words as one text: that is what moves when postings are read by block."""
    packed = weighted.groupBy("product_id").agg(F.collect_list(F.struct("term", "weight")).alias("w"), F.min(F.xxhash64("term")).alias("_sketch"))
    documents = materialize(packed.select("product_id", "_sketch", F.array_join("w.term", " ").alias("terms"), F.col("w.weight").alias("weights")))
    order = documents.select("product_id", "_sketch", F.col("product_id").alias("_document"))
    numbered = assign_dense_ids(order, ["_sketch", "product_id"], prefix="", column="_number")
    placed = numbered.select(F.col("_document").alias("product_id"), F.floor((F.col("_number").cast("bigint") - 1) / block).alias("block"))
    return materialize(documents.join(placed, "product_id").select("block", "product_id", "terms", "weights"))


def parts_of_blocks(rows: DataFrame) -> int:
    """As many parts as the session shuffles into, more where a part would hold over ``DOCUMENTS_A_PART`` documents."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DOCUMENTS_A_PART))


def bounded_scores(postings: DataFrame, terms: DataFrame, n: int, keep=None, block: int = BLOCK, parts: int | None = None) -> Bounded:
    """Scores of all documents that can be among a query's ``n`` best, and of some others.

    ``postings`` has (block, product_id, term, weight), ``terms`` (query_id, term, qtf). ``keep`` drops scored pairs
    (query_id, product_id, score) that do not meet a query's conditions; it is applied before the floor is taken. Postings that are partitioned by block, into ``parts`` parts, are not moved.
    """
    keep = keep or (lambda pairs: pairs)
    parts = parts or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = postings.groupBy("block", "term").agg(F.max("weight").alias("top"))
    bounds = materialize(tops.join(small_side(terms), "term").groupBy("query_id", "block").agg(F.sum(F.col("qtf") * F.col("top")).alias("bound")))
    asked = small_side(terms)
    # Queries are told by a slot each; two in one slot only let a block be scored for both.
    slots = min(MAX_SLOTS, 4 * max(1, terms.select("query_id").distinct().count()))
    slot = F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int")

    def scored(blocks: DataFrame) -> DataFrame:
        # A block's queries meet its documents as one row of marks, and sums are taken where the block is.
        marked = by_block(blocks.select("block", slot.alias("slot")), parts).groupBy("block").agg(F.sort_array(F.collect_set("slot")).alias("s"))
        marks = F.array_join(F.transform("s", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("s", i - 1), F.lit(-1)) - 1), F.lit("1"))), "")
        wanted = marked.select("block", marks.cast("binary").alias("marks")).hint("shuffle_hash")
        met = postings.join(wanted, "block").join(asked, "term").filter(F.substring("marks", slot + 1, F.lit(1)) == F.lit("1").cast("binary"))
        pairs = met.groupBy("query_id", "block", "product_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), SCORE_DIGITS).alias("score"))
        return keep(pairs.select("query_id", "product_id", "score"))

    first = materialize(top_k(bounds, ["query_id"], [F.desc("bound"), "block"], -(-2 * n // block) + 1).select("query_id", "block"))
    found = materialize(scored(first))
    floors = top_k(found, ["query_id"], [F.desc("score"), "product_id"], n).filter(F.col("position") == n).select("query_id", F.col("score").alias("floor"))
    # The room covers the order of sums and the rounding of scores.
    reaches = F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + 1e-8 >= F.col("floor"))
    then = materialize(bounds.join(first, ["query_id", "block"], "left_anti").join(floors, "query_id", "left").filter(reaches).select("query_id", "block"))
    # Both in one pass, so a pair met through a shared slot is there once.
    return Bounded(bounds, first, then, scored(first.unionByName(then)))


def bounded_search(texts: DataFrame, queries: DataFrame, n: int, text: str = "query_text", products: DataFrame | None = None, absent: str = "positive", block: int = BLOCK) -> DataFrame:
    """The same rows as ``search_texts``: n best documents per query, (query_id, product_id, score, position); a query without an id finds nothing."""
    terms = query_terms(queries, text).filter(F.col("query_id").isNotNull())
    many = not few_words(queries, text, MAX_BROADCAST_ROWS)
    asked_words = materialize(terms.select("term").distinct() if many else terms)
    # A table of checked size goes to all tasks; of a larger one the optimizer decides.
    send = F.broadcast if fits_inline(asked_words, MAX_BROADCAST_ROWS) else (lambda table: table)
    documents = blocked_documents(asked_weights(texts, asked_words, send), block)
    parts = parts_of_blocks(documents)
    postings = unpacked(by_block(documents, parts))
    keep = members = None
    if not many:
        terms = asked_words
    elif products is None:
        terms, members = word_sets(terms, unpacked(documents).select("term").distinct())
    else:
        terms = materialize(terms)
    if products is not None:
        attributes = products.select("product_id", F.struct(*LIST_ATTRIBUTES, *[r[0] for r in RANGES]).alias("p"))
        params = prepare_params(queries, absent).select("query_id", F.struct(*LIST_PARAMS, *RANGE_PARAMS).alias("q"))
        matches = match_condition(lambda c: F.col(f"p.{c}"), lambda c: F.col(f"q.{c}"))
        # Once per pair, after its score is summed.
        keep = lambda pairs: pairs.join(attributes, "product_id").join(small_side(params), "query_id").filter(matches).select("query_id", "product_id", "score")
    found = top_k(bounded_scores(postings, terms, n, keep, block, parts).scores, ["query_id"], [F.desc("score"), "product_id"], n)
    return found if members is None else for_members(found, members)


def bounded_topk(texts: DataFrame, queries: DataFrame, n: int = 120, text: str = "query_text", products: DataFrame | None = None, absent: str = "positive", block: int = BLOCK) -> DataFrame:
    """As ``sparse_topk``, on one text a product."""
    return bounded_search(one_field(texts), queries, n, text, products, absent, block)
