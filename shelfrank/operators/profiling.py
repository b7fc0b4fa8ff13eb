"""Catalogue profiling tables."""

from pyspark.sql import DataFrame, Window, functions as F

from shelfrank.functions.ranking import quantiles, stack_columns, top_k

DECILES = {f"{p}%": p / 100 for p in range(10, 100, 10)}
PERCENTILES = {**DECILES, "95%": 0.95, "98%": 0.98, "99%": 0.99}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every non-null value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values; ties go by the value."""
    return counts.orderBy(F.desc("n"), "value").limit(k)


def least_common(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy("n", F.desc("value")).limit(k)


def topk_plus_other(df: DataFrame, column: str, k: int, other: str = "Other") -> DataFrame:
    """Counts of the k most frequent values and one row for all the rest."""
    counts = value_counts(df, column)
    # Named structs keep a real value that is spelled like the label apart from the rest.
    top = most_common(counts, k).select("value", F.lit(True).alias("kept"))
    return (
        counts.join(top, "value", "left")
        .groupBy(F.when(F.col("kept"), F.col("value")).alias("value"), F.col("kept").isNull().alias("is_other"))
        .agg(F.sum("n").alias("n"))
        .select(F.when(F.col("is_other"), F.lit(other)).otherwise(F.col("value")).alias("value"), "is_other", "n")
    )


def list_value_counts(df: DataFrame, columns, k: int = 10) -> DataFrame:
    """Per list column: its k most frequent elements with count, share of all elements and number of distinct ones."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("items")) for c in columns])
    counts = (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.category", F.explode("pair.items").alias("value"))
        .groupBy("category", "value")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("category").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    return (
        top_k(counts, ["category"], [F.desc("n"), "value"], k)
        .join(totals, "category")
        .select(
            "category", "position", "value", "n",
            F.round(F.col("n") / F.col("total") * 100, 1).alias("percent"),
            "distinct_values", "total",
        )
    )


def row_key(columns):
    """Digest of whole rows; lists go in as text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def duplicate_groups(df: DataFrame, columns) -> DataFrame:
    """Groups of rows that agree on ``columns``: digest, size and the columns of one of them.

    Grouping on the digest keeps long texts out of the shuffle keys, and partial
    counts keep a group holding most of the rows cheap.
    """
    return (
        df.select(row_key(columns).alias("digest"), F.struct(*columns).alias("row"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.any_value("row").alias("row"))
        .filter("n > 1")
        .select("digest", "n", "row.*")
    )


def duplicate_rows(df: DataFrame, columns) -> DataFrame:
    """All rows whose ``columns`` occur more than once."""
    keyed = df.withColumn("digest", row_key(columns))
    repeated = keyed.groupBy("digest").count().filter("count > 1").select("digest")
    return keyed.join(repeated, "digest", "left_semi").drop("digest")


def duplicate_report(df: DataFrame, checks) -> DataFrame:
    """One row per check (name -> columns): rows affected, groups, and the largest group."""
    names = list(checks)
    digests = F.array(*[F.struct(F.lit(n).alias("check"), row_key(checks[n]).alias("digest")) for n in names])
    return (
        df.select(F.explode(digests).alias("d"))
        .groupBy("d.check", "d.digest")
        .agg(F.count("*").alias("n"))
        .groupBy("check")
        .agg(
            F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"),
            F.count_if(F.col("n") > 1).alias("duplicate_groups"),
            F.max("n").alias("largest_group"),
        )
    )


def describe_numeric(df: DataFrame, columns, points=None) -> DataFrame:
    """Long table (name, stat, value): count, mean, std, min, exact percentiles, max."""
    values = stack_columns(df, columns)
    moments = values.groupBy("name").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    stats = moments.unpivot("name", ["count", "mean", "std", "min", "max"], "stat", "value")
    return stats.unionByName(quantiles(values, points or PERCENTILES, True).withColumnRenamed("label", "stat"))


def histogram(df: DataFrame, column: str, bins: int = 100, below: float | None = None) -> DataFrame:
    """All ``bins`` equal-width bins between the smallest and the largest kept value: (bin from 0, low, high, n).

    With ``below`` only smaller values are kept. Without any value there are no bins.
    """
    kept = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if below is not None:
        kept = kept.filter(F.col("v") < below)
    ends = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    counts = kept.groupBy("v").agg(F.count("*").alias("n")).select("v", "n", lo.alias("lo"), hi.alias("hi"))
    # The largest value belongs to the last bin; a single distinct value is spread around.
    flat = F.col("hi") == F.col("lo")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    filled = counts.select(bin_no.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    every = ends.filter("lo IS NOT NULL").select(low.alias("low"), width.alias("width"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return (
        every.join(filled, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"), "n")
    )


def unpriced_classes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price").isNull()).select("product_class").distinct()


def topk_coverage(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows covered by the k most frequent values."""
    return most_common(value_counts(df, column), k).agg(F.sum("n").alias("covered"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values, null counted as one of them (exact unless asked otherwise)."""
    if approximate:
        counted = F.approx_count_distinct(column)
    else:
        counted = F.count_distinct(column)
    return df.agg((counted + F.max(F.col(column).isNull().cast("int"))).alias("distinct_values"))
