"""Session helpers shared by the entry file, the bench and the tests."""

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="12g"):
    """A local session with the settings the jobs are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfrank")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of column expressions are not recorded: plans are built several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The result survives lost executors and keeps its partition layout, so row
    positions inside a partition are the same on every later read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the session names, else one in the warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
