"""One place that builds the session and names the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def build(master: str = "local[8]", app: str = "tallymark", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; `partitions` is for local runs, a cluster sets its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallymark-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; it is deleted by `clean`, or when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/tallymark-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: For wide rows: row groups of 2 MB, looked at after each row. Parquet's own first look comes after 100 rows; a task holds them until then, and again, unpacked, when it reads them.
WIDE_ROWS = {"parquet.block.size": str(2 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def staged(df: DataFrame, tag: str, wide: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs nothing. `wide` is for rows of some 100 kB or more."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Hold the session's Arrow batches to `most` bytes, unless it has a tighter bound: Spark's own is 64 MB for each task on either side of the pipe to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("b")) > most:
        spark.conf.set(key, f"{most}b")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clean() -> None:
    """Delete what was staged so far. A session that runs many queries calls this once it has taken their results."""
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may have ended first
            return
