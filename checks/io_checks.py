"""Readers and writers: whole tables are written in the file format and read back."""

import uuid

from pyspark.sql import functions as F

from checks.fixtures import duck, table, view
from checks.registry import check, rounded
from shelfrank.operators import queryset as qs, textsearch as ts
from shelfrank.session import shared_folder
from shelfrank.sources import jsonsplit as js, readers as rd, writers as wr

LISTS = ["material", "style", "color", "countryoforigin"]


def folder(spark):
    """A new folder among the session's intermediate data."""
    return f"{shared_folder(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def joined(*columns):
    return [F.array_join(c, "|").alias(c) for c in columns]


@check("scan_tsv", f"WITH {duck('p')} SELECT product_id, product_name, product_class, product_description, product_features, rating_count, average_rating FROM p")
def _(spark, sf):
    path = folder(spark)
    raw = view(spark, sf, "p").select(
        "product_id", "product_name", "product_class", "product_description",
        "product_features", "rating_count", "average_rating", F.lit(None).cast("double").alias("review_count"),
    )
    raw.write.csv(path, sep="\t", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.scan_tsv(spark, path, multiline=True).drop("review_count")


@check("scan_jsonl", "SELECT event_id, event_type, false AS rejected FROM events WHERE user_id % 10 > 1 UNION ALL SELECT NULL, substr('{\"event_id\": ' || event_id, 1, 13 + length(event_id::varchar)), true FROM events WHERE user_id % 10 = 1")
def _(spark, sf):
    path = folder(spark)
    events = table(spark, sf, "events")
    whole = F.to_json(F.struct("event_id", "event_type"))
    # Some lines are cut short and some are blank: the first are rejected, the second skipped.
    line = F.when(F.col("user_id") % 10 == 0, F.lit("  ")).when(F.col("user_id") % 10 == 1, F.concat(F.lit('{"event_id": '), F.col("event_id"))).otherwise(whole)
    events.select(line.alias("value")).write.text(path)
    good, bad = rd.scan_jsonl(spark, path, "event_id bigint, event_type string")
    return good.select("event_id", "event_type", F.lit(False).alias("rejected")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("event_id"), F.col("line").alias("event_type"), F.lit(True).alias("rejected"))
    )


QUERY_ROWS = f"WITH {duck('q')} SELECT query_id, query_type, query_text, product_class, coalesce(array_to_string(color, '|'), '') AS color, price_max, rating_min, price_weight FROM q"
MAP_ROWS = f"WITH {duck('result_map')} SELECT query_id, array_to_string(product_ids, '|') AS product_ids FROM result_map"
QUERY_NAMES = ["product_class", "color", "price_max", "rating_min", "price_weight"]


def query_rows(read):
    return rd.flatten_params(read).select("query_id", "query_type", "query_text", *QUERY_NAMES).withColumn("color", F.coalesce(F.array_join("color", "|"), F.lit("")))


def query_arrays(spark, sf):
    """One file with one JSON array per query type."""
    path = folder(spark)
    q = view(spark, sf, "q")
    entry = lambda color: F.to_json(F.struct("query_id", "query_type", "query_text", F.struct(*[color.alias(n) if n == "color" else n for n in QUERY_NAMES]).alias("query_params")))
    # One colour stands as a string, several as a list.
    text = F.when(F.size("color") == 1, entry(F.get("color", F.lit(0)))).otherwise(entry(F.col("color")))
    nested = q.select(text.alias("j"), "query_type")
    # One array per query type: the number of queries is the size of a vocabulary.
    arrays = nested.groupBy("query_type").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@check("scan_json_array", QUERY_ROWS)
def _(spark, sf):
    return query_rows(rd.scan_json_array(spark, query_arrays(spark, sf)))


@check("scan_large_json_array", QUERY_ROWS)
def _(spark, sf):
    return query_rows(js.scan_large_json_array(spark, query_arrays(spark, sf)))


def result_objects(spark, sf):
    path = folder(spark)
    rows = view(spark, sf, "result_map")
    # One object per 1000 queries or so; each object is one file.
    entry = F.concat(F.lit('"'), F.col("query_id"), F.lit('": '), F.to_json("product_ids"))
    part = F.pmod(F.xxhash64("query_id"), F.lit(1 + rows.count() // 1000))
    objects = rows.groupBy(part.alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@check("scan_result_map", MAP_ROWS)
def _(spark, sf):
    return rd.scan_result_map(spark, result_objects(spark, sf)).select("query_id", *joined("product_ids"))


@check("scan_large_result_map", MAP_ROWS)
def _(spark, sf):
    return js.scan_large_result_map(spark, result_objects(spark, sf)).select("query_id", *joined("product_ids"))


@check("scan_lookup_map", """SELECT event_type AS raw, array_to_string(CASE WHEN last % 2 = 0 THEN [event_type || last, 'x'] ELSE [event_type || last] END, '|') AS normalized
 FROM (SELECT event_type, max(event_id) AS last FROM events GROUP BY ALL) e""")
def _(spark, sf):
    path = folder(spark)
    name = F.concat("event_type", F.col("event_id"))
    one, two = F.to_json(F.struct(F.col("event_type").alias("raw"), name.alias("normalized"))), F.to_json(F.struct(F.col("event_type").alias("raw"), F.array(name, F.lit("x")).alias("normalized")))
    table(spark, sf, "events").orderBy("event_id").select(F.when(F.col("event_id") % 2 == 0, two).otherwise(one).alias("value")).write.text(path)
    return rd.scan_lookup_map(spark, path).select("raw", *joined("normalized"))


@check("scan_price_ranges", "SELECT p_name AS product_class, min(p_retailprice) AS price_min, max(p_retailprice) AS price_max FROM part GROUP BY ALL")
def _(spark, sf):
    path = folder(spark)
    part = table(spark, sf, "part").groupBy(F.col("p_name").alias("product_class")).agg(F.min("p_retailprice").alias("price_min"), F.max("p_retailprice").alias("price_max"))
    # An outdated line for every class first; the one after it counts.
    old = part.select("product_class", F.lit(0.0).alias("price_min"), F.lit(1.0).alias("price_max"), F.lit(0).alias("o"))
    both = old.unionByName(part.withColumn("o", F.lit(1))).orderBy("o", "product_class").drop("o")
    both.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return rd.scan_price_ranges(spark, path)


@check("scan_feature_weights", """SELECT 'weight' AS kind, 'brand' AS name, lower(p_brand) AS item, max(p_size)::double AS a, NULL::double AS b, NULL::double AS c FROM part GROUP BY ALL
 UNION ALL SELECT 'threshold', p_type, NULL, min(p_size)::double, max(p_size)::double, count(*)::double FROM part GROUP BY ALL""")
def _(spark, sf):
    path = folder(spark)
    part = table(spark, sf, "part")
    # Tiers of brands by size: a brand in several tiers keeps the weight of the last line.
    tiers = part.groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("items")).select(
        F.lit("brand").alias("feature_type"), F.lit("tier").alias("category"), F.col("p_size").cast("double").alias("weight"), "items"
    )
    limits = part.groupBy("p_type").agg(F.array(F.min("p_size").cast("double"), F.max("p_size").cast("double"), F.count("*").cast("double")).alias("v"))
    config = limits.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_type", "v")))).alias("rating_thresholds")).select(
        F.to_json(F.struct(F.lit("rating_config").alias("feature_type"), "rating_thresholds")).alias("value"), F.lit(1000.0).alias("weight")
    )
    tiers.select(F.to_json(F.struct("*")).alias("value"), "weight").unionByName(config).orderBy("weight").select("value").write.text(path)
    weights, thresholds = rd.scan_feature_weights(spark, path)
    none = F.lit(None).cast("double")
    return weights.select(F.lit("weight").alias("kind"), F.col("feature_type").alias("name"), "item", F.col("weight").alias("a"), none.alias("b"), none.alias("c")).unionByName(
        thresholds.select(F.lit("threshold").alias("kind"), "name", F.lit(None).cast("string").alias("item"), F.col("low").alias("a"), F.col("high").alias("b"), F.col("multiplier").alias("c"))
    )


def stored_embeddings(spark, sf):
    """Embedding lines, every other one in the older sparse layout."""
    rows = table(spark, sf, "embeddings").withColumn("pos", F.sequence(F.lit(0), F.size("embedding") - 1)).withColumn("val", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))
    odd = F.col("vec_id") % 2 == 1
    sparse = F.struct(F.when(~odd, F.col("pos")).alias("indices"), F.when(odd, F.col("pos")).alias("dimensions"), F.col("val").alias("values"))
    meta = F.struct(F.concat(F.lit("label "), F.col("label")).alias("product_name"), F.col("label").cast("bigint").alias("rating_count"))
    ident = F.when(F.col("label") == 3, F.concat(F.lit("item-"), F.col("vec_id"))).otherwise(F.concat(F.lit("product_"), F.col("vec_id")))
    return rows.select(ident.alias("id"), F.col("embedding").alias("dense_embedding"), sparse.alias("sparse_embedding"), meta.alias("metadata"))


@check("scan_embeddings", f"""SELECT CASE label WHEN 3 THEN 'item-' ELSE 'product_' END || vec_id AS product_id, len(embedding) AS size, {rounded('embedding[64]::double', 6)} AS last_value, array_to_string(range(len(embedding)), '|') AS indices,
 {rounded('embedding[2]::double', 6)} AS second, 'label ' || label AS product_name, label::bigint AS rating_count FROM embeddings""")
def _(spark, sf):
    path = folder(spark)
    stored_embeddings(spark, sf).write.json(path)
    got, _rejects = rd.scan_embeddings(spark, path)
    return got.select(
        "product_id", F.size("vector").cast("long").alias("size"), F.round(F.element_at("vector", -1).cast("double"), 6).alias("last_value"), F.array_join("sparse.indices", "|").alias("indices"),
        F.round(F.get("sparse.values", F.lit(1)), 6).alias("second"), "metadata.product_name", "metadata.rating_count",
    )


@check("write_embeddings", "SELECT id, row_number() OVER (ORDER BY try_cast(replace(id, 'product_', '') AS bigint) NULLS LAST, id) AS place FROM (SELECT CASE label WHEN 3 THEN 'item-' ELSE 'product_' END || vec_id AS id FROM embeddings) e")
def _(spark, sf):
    path = folder(spark)
    wr.write_embeddings(stored_embeddings(spark, sf), path)
    # Part files are named in order, so file name and place in the file give the written order.
    rows = spark.read.schema("id string").json(path).select("id", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")).alias("o"))
    from shelfrank.operators.catalog import assign_dense_ids

    return assign_dense_ids(rows.withColumn("place", F.lit("")), ["o"], "", "place").select("id", F.col("place").cast("bigint").alias("place"))


@check("write_products", f"WITH {duck('c')} SELECT 'json' AS kind, product_id, product_description, array_to_string(color, '|') AS color, price FROM c UNION ALL SELECT 'csv', product_id, product_description, to_json(color)::varchar, price FROM c")
def _(spark, sf):
    path = folder(spark)
    products = view(spark, sf, "c").select(*[c.split(" ")[0].strip() for c in rd.PRODUCT_SCHEMA.split(", ")])
    wr.write_products(products, f"{path}/json", f"{path}/csv")
    rows, _rejects = rd.scan_jsonl(spark, f"{path}/json")
    text = spark.read.schema("product_id string, product_name string, product_description string, product_class string, material string, style string, color string, countryoforigin string, rating_count bigint, average_rating double, price double")
    csv = text.csv(f"{path}/csv", header=True, escape='"', multiLine=True)
    return rows.select(F.lit("json").alias("kind"), "product_id", "product_description", *joined("color"), "price").unionByName(
        csv.select(F.lit("csv").alias("kind"), "product_id", "product_description", "color", "price")
    )


from checks.queryset_checks import PROFILE, SHOW_SETS  # noqa: E402


@check("write_profile", f"WITH {PROFILE} SELECT product_class, {SHOW_SETS}, rating_lo, rating_hi, price_lo, price_hi FROM prof")
def _(spark, sf):
    path = folder(spark)
    wr.write_profile(qs.class_profile(qs.top_classes(view(spark, sf, "c"))), path)
    schema = "product_class string, materials array<string>, colors array<string>, styles array<string>, rating_lo double, rating_hi double, price_lo double, price_hi double"
    return spark.read.schema(schema).json(path).select("product_class", *joined("materials", "colors", "styles"), "rating_lo", "rating_hi", "price_lo", "price_hi")


@check("write_result_map", f"WITH {duck('result_map')} SELECT query_id, array_to_string(product_ids, '|') AS product_ids FROM result_map")
def _(spark, sf):
    path = folder(spark)
    hits = view(spark, sf, "one_system")
    queries = view(spark, sf, "result_map").select("query_id")
    wr.write_result_map(queries, hits, path, "rank")
    return rd.scan_result_rows(spark, path).select("query_id", *joined("product_ids"))


@check("scan_rankings", f"WITH {duck('one_system')} SELECT query_id, product_id, rank, query_type FROM one_system")
def _(spark, sf):
    path = folder(spark)
    wr.write_rankings(view(spark, sf, "one_system"), path)
    return rd.scan_rankings(spark, path)
