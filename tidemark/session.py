"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: What the planner says of rows that do not come from files is beyond this.
UNKNOWN_SIZE = 1 << 60
MAX_WIDTH = 100_000


def build_session(app: str = "tidemark", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session with the settings that the library assumes (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: zone-less timestamps of the tables mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is a single local JVM is a
    temporary folder of our own used; on a cluster its absence is an error, as a
    folder of one machine would be lost with that machine.
    """
    sc = spark.sparkContext
    found = sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table, deleted when the driver ends."""
    base = f"{shared_dir(spark)}/tidemark"
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """The rows, written to the shared folder and read from there; survives the loss of executors.

    Unlike a checkpoint the table is columnar, so that readers take only what
    they need, and it is deleted when the driver ends.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def width_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Into how many partitions to spread rows where Spark may not choose.

    Enough for ``bytes_each`` of the files that the rows come from, and at least
    the session's number of shuffle partitions.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < UNKNOWN_SIZE)
    return min(MAX_WIDTH, max(shuffle_width(df.sparkSession), known // bytes_each))
