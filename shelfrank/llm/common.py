"""Helpers the operators of this folder share."""

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors with the job, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns: ``new=old``.

    Names are matched exactly and by position, so other columns, also ones that differ
    in case only or are called like a result column, are dropped without ambiguity.
    """
    names = df.columns
    missing = [old for old in columns.values() if old not in names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {', '.join(names)}")
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there.

    Where the session names none, as in tests, a folder in the warehouse is used: the
    warehouse is shared as well.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def utf8(text: Column) -> Column:
    """The bytes of a text, none for a null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, cells: int = 512) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 inside each group, in an order fixed by the rows.

    Rows are ranked inside (group, hash cell) and the sizes of the cells before are added,
    so a group with most of the rows is numbered by many tasks. The rows move once; the
    second table has at most groups x cells rows. Equal rows get different numbers.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells))
    spread = df.withColumn("_cell", cell)
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(*order)))
    sizes = spread.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(starts, [*groups, "_cell"]).withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_cell", "_rank", "_start")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, root) for each node but the roots.

    The root is the smallest node reachable. Large-star and small-star rounds (Kiveris et al., 2014) run until
    every edge joins a node to a root; the edges are written after each round. The number
    of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("m").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
        roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        if roles.filter("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
        edges = stored(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour or itself."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("m").alias("low"))
    tied = edges.join(least, "v")
    moved = tied.filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return moved.union(least.select("v", F.col("low").alias("m"))).distinct()


ship(__name__)
