"""Documents to packed training pieces: rules, classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), where docs are the rows its predecessor kept, and is
written and read again before the next one. All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfrank.llm import byte_cnn, compression_bands, length_buckets, queries, secret_scan, simhash_index
from shelfrank.llm.common import pick, utf8

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document goes when the classifier gives it less than this.
LEAST_QUALITY = 0.5
# SQL can't express compression, the network or the forest.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word, repeat and compression rules."""
    judge = compression_bands.verdict_udf()
    rules = judge(utf8(F.col("text")))
    return _documents(docs).withColumn("_made", rules).filter(compression_bands.kept_by(F.col("_made"))).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the network, trained on the labelled ones among them, does not reject."""
    docs = _documents(docs)
    net = queries.quality_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(byte_cnn.scorer(net)(utf8(F.col("text"))) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash over three-word shingles, links of at most three bits."""
    return simhash_index.one_per_group(_documents(docs), size=3, most=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` counts the new text."""
    docs = _documents(docs)
    clean = secret_scan.redacted(docs, secret_scan.secret_scan(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in length buckets and batches of a token budget."""
    return length_buckets.length_buckets(_documents(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written below ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{home.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
