"""Session settings and the shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Readers decode up to 4,096 rows at once, but none beyond a row group.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

CELLS = 1 << 20  # of arrays in one row group: 8 MB of doubles, of which readers hold several times as much


def wide_rows(width: int) -> dict[str, str]:
    """Writer options for arrays of ``width`` cells that repeat few values: rows of a group are limited by their decoded
    size, which LARGE_ROWS cannot see where a dictionary makes them small, and keep their dictionary."""
    return {"parquet.block.row.count.limit": str(max(1, CELLS // max(width, 1)))}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on: adaptive joins that split a hot key."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split a hot key even where the split costs one more exchange after the join.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder;
    a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="affinity-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/affinity/{app}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative jobs a reliable checkpoint folder unless the session has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def written(df: DataFrame, name: str, by: str | None = None, **options) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table outlives lost executors, fixes nondeterministic columns once, and
    gives later joins a real size to choose their strategy by. With ``by`` each value
    of that column has its own folder, so a filter on it reads, and sizes, only that. ``options`` go to
    the writer; ``LARGE_ROWS`` keeps tasks from holding thousands of rows of a megabyte at once.
    An application's tables share one folder, to be removed when it has ended. The write's shuffle files go with
    the write, not when the driver collects its garbage: nothing reads them again.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        if by is None:
            df.write.options(**options).parquet(path)
        else:
            df.hint("rebalance", by).write.options(**options).partitionBy(by).parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
