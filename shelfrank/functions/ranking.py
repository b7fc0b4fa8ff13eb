"""Top-k per group and exact order statistics."""

from pyspark.sql import DataFrame, Window, functions as F


def top_k(df: DataFrame, group, order, k, position="position") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    The filter on the row number lets Spark cut every map partition to ``k`` rows
    per group before the shuffle, so one huge group costs no more than a small one.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)


BUCKETS = 128


def value_ranks(values: DataFrame) -> DataFrame:
    """Rank range of every distinct value of each named column.

    ``values`` holds (name, value double). Result: (name, value, before, upto, total)
    where the value takes the sorted positions ``before`` .. ``upto - 1``.

    Rows are first reduced to one per distinct value. Distinct values then go into
    ``BUCKETS`` ranges of about equally many values, cut at approximate quantiles of the
    column, so running sums are taken inside buckets in parallel; only the bucket totals
    are summed in one task per name. The cuts only spread the work: ranks are exact.
    """
    real = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # One short array per column name.
    cuts = real.groupBy("name").agg(F.array_distinct(F.percentile_approx("value", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).alias("cuts")).collect()
    bucket = F.lit(0)
    for row in cuts:
        found = F.size(F.filter(F.array(*[F.lit(c) for c in row.cuts]), lambda c: c < F.col("value")))
        bucket = F.when(F.col("name") == row.name, found).otherwise(bucket)
    counts = real.groupBy("name", "value").agg(F.count("*").alias("n")).withColumn("bucket", bucket.cast("long"))
    by_bucket = Window.partitionBy("name").orderBy("bucket")
    offsets = (
        counts.groupBy("name", "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .withColumn("offset", F.sum("bucket_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("total", F.sum("bucket_n").over(Window.partitionBy("name")))
        .select("name", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"), "total")
    )
    inside = Window.partitionBy("name", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(offsets, ["name", "bucket"])
        .withColumn("upto", F.col("offset") + F.sum("n").over(inside))
        .select("name", "value", (F.col("upto") - F.col("n")).alias("before"), "upto", "total")
    )


def stack_columns(df: DataFrame, columns) -> DataFrame:
    """Long form (name, value double) of numeric columns, one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("pair")).select("pair.*")


def quantiles(values: DataFrame, points, interpolate: bool) -> DataFrame:
    """Exact quantiles of (name, value): one row (name, label, value) per point.

    ``points`` maps labels to fractions. Without interpolation the value at the
    floor of ``q * (n - 1)`` is taken, with it the usual linear mix of the two
    neighbours.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(q)).alias("q")) for k, q in points.items()])
    hits = (
        value_ranks(values)
        .withColumn("point", F.explode(wanted))
        .withColumn("at", F.col("point.q") * (F.col("total") - 1))
    )
    low = F.floor("at")
    covers_low = (F.col("before") <= low) & (low < F.col("upto"))
    if not interpolate:
        return hits.filter(covers_low).select("name", "point.label", "value")
    high = F.ceil("at")
    covers_high = (F.col("before") <= high) & (high < F.col("upto"))
    return (
        hits.filter(covers_low | covers_high)
        .groupBy("name", F.col("point.label").alias("label"), "at")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .select("name", "label", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))
    )
