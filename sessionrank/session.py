"""Spark session settings and the shared folder for cut lineage and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every plan of this package relies on. Skew splitting is forced
# because a split join may cost one more exchange, which is cheap next to a hot task.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash joins where every partition of the build side is known to be small; saves sorting the wide side
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # packed rows are large: batches for Python are bounded by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


# A scan task aggregates its rows before they are exchanged, so its memory goes with the rows of
# its piece of a file. Larger settings are lowered to this; smaller ones stay.
SCAN_BYTES = 32 << 20
SCAN_SETTING = "spark.sql.files.maxPartitionBytes"


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session made elsewhere."""
    for name, value in RUNTIME.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    if _bytes(spark.conf.get(SCAN_SETTING)) > SCAN_BYTES:
        spark.conf.set(SCAN_SETTING, str(SCAN_BYTES))
    return spark


def local_session(cores: int | str = "*", app: str = "sessionrank", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the cluster's checkpoint folder.

    A temporary folder is used only in local mode, where one machine is the cluster.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="sessionrank-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def output_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never written before."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint: fixed content, no lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as compressed columns below the shared folder and read back: fixed content without lineage, in less room than a checkpoint of rows."""
    path = output_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


NARROW_ROWS = 1_000_000


def narrow(df: DataFrame, most: int | None = None) -> DataFrame:
    """A table of a key and a few short columns: counted, and marked for broadcast up to ``most`` rows.

    Adaptive execution decides by bytes, and only after the other side of the join has been exchanged.
    """
    return F.broadcast(df) if df.count() <= (NARROW_ROWS if most is None else most) else df
