"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "shelfmark", *, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; a cluster's own master is kept."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """Test-scale session: one JVM, as many shuffle partitions as cores."""
    return build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.default.parallelism": str(cpus),
            "spark.driver.memory": os.environ.get("SHELFMARK_DRIVER_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            **conf,
        },
    )


#: Spark removes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Session and name of each setting held, with the number of holders and the value before.
_HELD: dict[tuple, list] = {}
_HELD_LOCK = threading.Lock()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block. Jobs that run at the same time share them; the last one to
    leave puts back what was there."""
    with _HELD_LOCK:
        for name, value in values.items():
            _HELD.setdefault((spark._jsparkSession, name), [0, spark.conf.get(name, None)])[0] += 1
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _HELD_LOCK:
            for name in values:
                held = _HELD[spark._jsparkSession, name]
                held[0] -= 1
                if held[0] == 0:
                    before = _HELD.pop((spark._jsparkSession, name))[1]
                    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def at_most(spark: SparkSession, name: str, size: str) -> str:
    """``size``, or the session's own value of ``name`` if that is smaller."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    own = spark.conf.get(name)
    return own if as_bytes(own) <= as_bytes(size) else size


def small_broadcasts(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """For plans of very many joins. All that one execution broadcasts stays with the driver until its end, each table in
    a memory page at least, and tables of few different values take some forty times their stored size there. Only what runs inside
    the block is held to it, so settle what is to be handed on."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    return settings(spark, {name: at_most(spark, name, "1m")})


def in_utc(spark: SparkSession) -> SparkSession:
    """Dates here are UTC days; a caller's session may say otherwise."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir; a local one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder, grouped by application."""
    return f"{ensure_checkpoint_dir(spark)}/shelfmark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    Used where a loop would otherwise grow its lineage every round, and where a value that
    depends on the physical layout (a range-partition number) must stay the same for every
    reader. A written table also survives lost executors and tells the optimizer its size. The
    shuffle files that made it go once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


def release(df: DataFrame) -> None:
    """Remove the table that ``settle`` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
