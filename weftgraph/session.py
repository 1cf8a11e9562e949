"""What every operator needs of the session: tables, the shared folder and stored intermediate tables."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHARED_KEY = "spark.checkpoint.dir"
MOST_BROADCAST = 500_000  # rows of a driver's table that is broadcast: rows of a few numbers and names, some tens of MB
_made: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftgraph")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A local session without one gets a temporary folder; a cluster without one is an error."""
    path = spark.sparkContext.getConf().get(_SHARED_KEY) or spark.conf.get(_SHARED_KEY, None)
    if path:
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{_SHARED_KEY} must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="weftgraph-")
    spark.conf.set(_SHARED_KEY, path)
    return path


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is deleted when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/weftgraph-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_stored)
    _made.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    hollow = [f for f in df.schema if f.dataType == T.StructType([])]  # Parquet has no struct without fields
    kept = df.drop(*[f.name for f in hollow])
    kept.write.parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).cast("struct<>").alias(f.name) if f in hollow else F.col(f"`{f.name}`") for f in df.schema])


def _drop_stored() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended, or the folder is gone: the owner of the shared folder cleans up
            continue


def small_table(spark: SparkSession, rows: list[tuple], schema: str, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of the driver as a table that is broadcast in joins if it has at most ``most`` rows, and else joined as Catalyst sees fit."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= most else table


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of shuffle partitions: the session's, or more where a task would get over ``rows_per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_task))
