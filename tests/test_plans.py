"""Plan shapes that matter at scale, and repeatability."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import all_checks
from checks.fixtures import view
from shelfrank.functions import ranking
from shelfrank.operators import evaluate as ev, filters, profiling as prof, textsearch as ts

SF = "/root/testdata/sf0.001"
# These train or score in Python workers on Arrow batches; everything else stays in the JVM.
ARROW = {"dense_topk", "dbsf_fusion", "hybrid_search", "multi_attribute_search"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["eval_systems", "param_filter", "sparse_topk", "fielded_search", "normalize_features", "add_prices", "class_profile", "describe_numeric", "extract_params", "rerank_topn", "mine_class_terms"])
def test_no_python_and_no_cross_join(spark, key):
    text = plan(entry.queries()[key](spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def unpartitioned_windows(text):
    """Windows without partition keys, which gather their input in one task."""
    return [line for line in text.splitlines() if re.search(r"\bWindow \[", line) and not re.search(r"\], \[[^\]]+#\d+", line)]


def test_no_row_level_window_in_one_task(spark):
    # Catalogue-sized windows are all partitioned; only counted tables (slices, buckets, partitions) are summed in one task.
    for key in ("eval_systems", "side_by_side", "list_value_counts", "class_descriptions", "sparse_topk"):
        assert unpartitioned_windows(plan(entry.queries()[key](spark, SF))) == [], key


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(ev.pred_topk(view(spark, SF, "systems")))
    assert re.search(r"WindowGroupLimit.*Partial", text) and re.search(r"WindowGroupLimit.*Final", text)


def test_search_pairs_stay_in_their_partition(spark):
    """Between the document partitioning and the per-query cut there is no shuffle of document-query pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("product_id"), "text")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    text = plan(ts.sparse_topk(docs, asked, 20))
    assert "hashpartitioning(query_id#" in text and "REPARTITION_BY_NUM" in text
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, product_id#", text)


def test_scan_reads_only_needed_columns(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = plan(prof.value_counts(lines.filter("l_quantity > 10"), "l_returnflag"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text and "GreaterThan(l_quantity,10.0)" in text


def test_filter_joins_on_many_keys(spark):
    """Queries without a wanted attribute meet the products under many keys, none of which holds most products."""
    products = spark.range(6400).select(F.concat(F.lit("p"), "id").alias("product_id"), *[F.array(F.lit("x")).alias(a) for a in filters.LIST_ATTRIBUTES])
    keys = products.groupBy(F.pmod(F.xxhash64("product_id"), F.lit(filters.SPREAD))).count().collect()
    assert len(keys) == filters.SPREAD and max(k["count"] for k in keys) < 200
    text = plan(entry.queries()["param_filter"](spark, SF))
    assert "any#" in text and "hashpartitioning(any" not in text


@pytest.mark.parametrize("key,column", [("remap_class", "product_class"), ("add_prices", "product_class"), ("pricing_counters", "product_class"), ("assign_dense_ids", "_part")])
def test_small_tables_do_not_shuffle_the_catalogue(spark, key, column):
    df = entry.queries()[key](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    joins = [line for line in final.splitlines() if "Join" in line]
    assert joins and not any("SortMergeJoin" in j and column in j for j in joins)
    wide = [line for line in final.splitlines() if f"Exchange hashpartitioning({column}" in line and "ENSURE_REQUIREMENTS" in line]
    # What is grouped by that column is counts per key; the join itself needs no exchange.
    assert len(wide) <= (1 if column == "_part" else 0)


def test_quantile_buckets_follow_the_data(spark):
    """A column in a narrow band far from zero is spread over many buckets."""
    band = spark.range(20000).select(F.lit("v").alias("name"), (F.col("id") + 1e9).alias("value"))
    ranks = {r.value: r.before for r in ranking.value_ranks(band).filter("before % 4999 = 0").collect()}
    assert ranks == {1e9 + i: i for i in range(0, 20000, 4999)}
    text = plan(ranking.value_ranks(band))
    cuts = spark.range(20000).agg(F.percentile_approx(F.col("id") + 1e9, [i / ranking.BUCKETS for i in range(1, ranking.BUCKETS)], 10 * ranking.BUCKETS)).first()[0]
    assert "bucket" in text and len(set(cuts)) == ranking.BUCKETS - 1


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["system", "query_type", "queries", "precision", "recall", "mrr", "ndcg"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_checks.QUERIES) - set(all_checks.ORACLES) == {"build_benchmark"}


def test_hot_query_and_hot_document(spark):
    """A query with most of the rows gives the same answer as small ones."""
    hot = spark.range(60000).select(F.when(F.col("id") < 40000, "hot-1").otherwise(F.concat(F.lit("q-"), F.col("id") % 50)).alias("query_id"),
                                    F.concat(F.lit("d"), F.col("id") % 997).alias("product_id"), (F.col("id") % 5003).cast("int").alias("rank"))
    truth = hot.filter("rank % 3 = 0")
    got = {r.query_id: r for r in ev.eval_by_query(hot, truth, 10).collect()}
    assert len(got) == 51 and got["hot-1"].mrr == 1.0 and 0 < got["hot-1"].ndcg <= 1


def test_skewed_filter_value(spark):
    products = spark.range(3000).select(
        F.concat(F.lit("p"), "id").alias("product_id"), F.lit("K").alias("product_class"), F.array(F.when(F.col("id") % 3 == 0, "red").otherwise(F.concat(F.lit("c"), "id"))).alias("color"),
        F.array(F.lit("wood")).alias("material"), F.array(F.lit("m")).alias("style"), F.col("id").cast("double").alias("price"), F.lit(4.0).alias("average_rating"), F.lit(5).alias("rating_count"),
    )
    asked = spark.createDataFrame([("a", ["red"], 300.0), ("b", ["red", "c1"], None), ("c", None, 9.0)], "query_id string, color array<string>, price_max double")
    got = {r.query_id: r["count"] for r in filters.param_filter(products, asked).groupBy("query_id").count().collect()}
    assert got == {"a": 101, "b": 1001, "c": 10}


def test_systems_are_ranked_where_their_lines_are(spark):
    """Lines move once, before there is a row of each system; ranking and scoring need no second exchange of predictions."""
    text = plan(ev.pred_topk(view(spark, SF, "systems", dealt=True)))
    assert text.count("Exchange ") == 1 and text.index("Generate explode") < text.index("Exchange hashpartitioning(query_id")
    scored = plan(ev.eval_by_query(view(spark, SF, "systems", dealt=True), view(spark, SF, "truth")))
    assert scored.count("REPARTITION_BY_NUM") == 1 and not re.search(r"Exchange hashpartitioning\((system|query_id#\d+, product_id)", scored)


def test_predictions_are_scored_where_they_were_ranked(spark):
    """Where the truth is too large to be sent whole, predictions still move only once, and each line has no column more than is needed."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ev.evaluate_rankings(view(spark, SF, "systems", dealt=True), view(spark, SF, "truth"))[0])
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert not any(re.search(r"hashpartitioning\((system#\d+, \w+#\d+, \d+\)|_?query(_id)?#\d+, _?\w+#)", line) for line in exchanges)
        assert sum("REPARTITION_BY_NUM" in line for line in exchanges) == 1 and "SortMergeJoin [query_id" in text
        moved = [below for line, below in zip(text.splitlines(), text.splitlines()[1:]) if "Exchange hashpartitioning(query_id" in line]
        assert moved and not any("supp_" in line for line in moved)
        got = ev.evaluate_rankings(view(spark, SF, "systems", dealt=True), view(spark, SF, "truth"))[0].collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(got) == sorted(ev.evaluate_rankings(view(spark, SF, "systems"), view(spark, SF, "truth"))[0].collect()) and got


def test_documents_without_a_name_are_never_relevant(spark):
    """Null documents and queries match nothing; a document shown twice counts twice."""
    shown = spark.createDataFrame([("a-1", None, 1), ("a-1", "x", 2), ("a-1", "x", 3), (None, "x", 1), ("b-1", "y", 1)], "query_id string, product_id string, rank int")
    truth = spark.createDataFrame([("a-1", None, 1), ("a-1", "x", 2), (None, "x", 1), ("b-1", "z", 1)], "query_id string, product_id string, rank int")
    got = {r.query_id: (r.precision, r.recall, r.mrr, r.pred_docs, r.gt_size) for r in ev.eval_by_query(shown, truth).collect()}
    assert got == {"a-1": (1.0, 1.0, 0.5, [None, "x", "x"], 2), "b-1": (0.0, 0.0, 0.0, ["y"], 1)}
