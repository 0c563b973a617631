"""Session helpers: shared scratch space, lineage cuts and size checks for broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A join side is broadcast only when one aggregate pass has shown it to be below both bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Bytes of the Arrow batches that go to Python; a worker holds a batch several times over, as Arrow and as objects.
ARROW_BATCH_BYTES = 4 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on (time zone, ANSI errors), turn on AQE and bound Arrow batches."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def instant(at: datetime) -> Column:
    """A point in time as a literal; without a zone it is UTC, whatever the zone of the machine."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the one in ``spark.checkpoint.dir``.

    Local sessions may leave it unset and get a new folder; on a cluster that is an error, because each
    executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back.

    Used where a frame is read more than once and recomputing it is expensive or not
    repeatable (model calls). The copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files would leave most of them idle.

    A row group is read by one task, however large it is. Rows a task are counted without reading a column.
    """
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    row = tasks.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (row["most"] or 0) * df.sparkSession.sparkContext.defaultParallelism <= 2 * (row["all"] or 0):
        return df
    return df.repartition(*df.columns)


def _width(col: Column, kind: T.DataType) -> Column:
    """Approximate bytes of a value, from lengths alone."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.StructType):
        size = sum((_width(col[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(col, "")) + F.size(col) * 8
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.size(col) * 8
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = F.octet_length(F.to_json(col))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes, by one partially aggregated pass."""
    row_bytes = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast when it was measured below the bounds, else leave it alone."""
    rows, size = measure(df)
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False
