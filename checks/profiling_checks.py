"""Profiling tables over the derived catalogue, the documents and the lines."""

from pyspark.sql import functions as F

from checks.evaluate_checks import describe_sql
from checks.fixtures import duck, ranges_duck, table, view
from checks.registry import check, rounded
from shelfrank.operators import profiling as prof

C = duck("c")
LISTS = ["style", "material", "color", "countryoforigin"]


def products(spark, sf):
    return view(spark, sf, "c")


@check("topk_plus_other", f"""WITH {C}, n AS (SELECT product_name AS value, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn FROM n)
 SELECT value, false AS is_other, n FROM r WHERE rn <= 32 UNION ALL SELECT 'Other', true, cast(sum(n) AS bigint) FROM r WHERE rn > 32""")
def _(spark, sf):
    return prof.topk_plus_other(products(spark, sf), "product_name", 32)


@check("value_counts", f"""WITH {C}, n AS (SELECT product_name AS value, count(*) AS n FROM c GROUP BY ALL)
 (SELECT 'head' AS part, value, n FROM n ORDER BY n DESC, value LIMIT 10) UNION ALL (SELECT 'tail', value, n FROM n ORDER BY n, value DESC LIMIT 60)""")
def _(spark, sf):
    counts = prof.value_counts(products(spark, sf), "product_name")
    head = prof.most_common(counts, 10).select(F.lit("head").alias("part"), "value", "n")
    return head.unionByName(prof.least_common(counts, 60).select(F.lit("tail").alias("part"), "value", "n"))


@check("list_value_counts", f"""WITH {C}, e AS ({' UNION ALL '.join(f"SELECT '{c}' AS category, unnest({c}) AS value FROM c" for c in LISTS)}),
 n AS (SELECT category, value, count(*) AS n FROM e GROUP BY ALL),
 t AS (SELECT *, cast(row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS int) AS position, cast(sum(n) OVER (PARTITION BY category) AS bigint) AS total, count(*) OVER (PARTITION BY category) AS distinct_values FROM n)
 SELECT category, position, value, n, {rounded('n / total * 100', 1)} AS percent, distinct_values, total FROM t WHERE position <= 10""")
def _(spark, sf):
    return prof.list_value_counts(products(spark, sf), LISTS)


@check("duplicate_report", """WITH t AS (SELECT text, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY ALL)
 SELECT 'text' AS "check", cast(coalesce(sum(n) FILTER (n > 1), 0) AS bigint) AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_groups, max(n) AS largest_group FROM t
 UNION ALL SELECT 'row', cast(coalesce(sum(n) FILTER (n > 1), 0) AS bigint), count(*) FILTER (n > 1), max(n) FROM s""")
def _(spark, sf):
    return prof.duplicate_report(table(spark, sf, "documents"), {"text": ["text"], "row": ["text", "lang", "source"]})


@check("duplicate_rows", "SELECT doc_id, text FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def _(spark, sf):
    return prof.duplicate_rows(table(spark, sf, "documents"), ["text"]).select("doc_id", "text")


@check("duplicate_groups", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    return prof.duplicate_groups(table(spark, sf, "documents"), ["text"]).select("text", "n")


@check("describe_numeric", f"""WITH {C} {describe_sql('c', 'price', 'price', prof.PERCENTILES)} UNION ALL {describe_sql('c', 'rating_count', 'cast(rating_count AS double)', prof.PERCENTILES)}
 UNION ALL {describe_sql('c', 'average_rating', 'average_rating', prof.PERCENTILES)}""")
def _(spark, sf):
    return prof.describe_numeric(products(spark, sf), ["price", "rating_count", "average_rating"]).withColumn("value", F.round("value", 6))


@check("histogram", f"""WITH v AS (SELECT l_quantity * l_tax * 10 AS v FROM lineitem), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 100 AS w FROM v),
 f AS (SELECT cast(least(floor((v - lo) / w), 99) AS bigint) AS bin, count(*) AS n FROM v JOIN e ON true GROUP BY ALL)
 SELECT bin, {rounded('lo + bin * w', 6)} AS bin_low, coalesce(n, 0) AS n FROM (SELECT unnest(range(100)) AS bin) b LEFT JOIN f USING (bin) JOIN e ON true""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("v", F.col("l_quantity") * F.col("l_tax") * 10)
    return prof.histogram(lines, "v", 100).select("bin", F.round("bin_low", 6).alias("bin_low"), "n")


@check("unpriced_classes", f"WITH {C} SELECT DISTINCT product_class FROM c WHERE price IS NULL")
def _(spark, sf):
    return prof.unpriced_classes(products(spark, sf))


@check("topk_coverage", f"WITH {C} SELECT cast(sum(n) AS bigint) AS covered FROM (SELECT count(*) AS n, product_name FROM c GROUP BY ALL ORDER BY 1 DESC, 2 LIMIT 50) x")
def _(spark, sf):
    return prof.topk_coverage(products(spark, sf), "product_name", 50)


@check("distinct_count", f"WITH {duck('p')} SELECT count(DISTINCT product_class) + max(cast(product_class IS NULL AS int)) AS distinct_values FROM p")
def _(spark, sf):
    return prof.distinct_count(view(spark, sf, "p"), "product_class")
