"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins from real shuffle sizes, coalesces small
# partitions and splits skewed ones; timestamps are wall-clock (no zone shifts).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxPlanStringLength": "20000",
}


# Runtime SQL settings applied to any session a job is handed (they can change after start-up).
RUNTIME_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # plans over cached intermediate results nest; keep their printed form bounded
    "spark.sql.maxPlanStringLength": "20000",
}


# Compressed bytes that one scan task reads at most: rows of the stored tables take about ten times as much in
# memory, and a task that sorts its whole share must not spill.
SCAN_BYTES = 32 << 20


# Parts of the driver's heap bound that a step may leave taken from the system, and in use with what is over.
HEAP_TAKEN, HEAP_USED = 0.45, 0.35
# Per cent of the driver's heap that a collection keeps free (the JVM's own: at least 40, at most 70).
HEAP_FREE = {"MinHeapFreeRatio": "20", "MaxHeapFreeRatio": "40"}


def tune_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SQL_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # a locked-down session may refuse; defaults still work
            pass
    conf = spark._jsparkSession.sessionState().conf()
    if conf.filesMaxPartitionBytes() > SCAN_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SCAN_BYTES))
    keep_heap_tight(spark)
    return spark


def keep_heap_tight(spark: SparkSession) -> bool:
    """Have the driver's JVM return free heap beyond ``HEAP_FREE`` at a collection (options made to be set while it
    runs); whether it could."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        text = gateway.new_array(jvm.java.lang.Class, 2)
        text[0] = text[1] = jvm.java.lang.Class.forName("java.lang.String")
        for option, percent in HEAP_FREE.items():
            given = gateway.new_array(jvm.java.lang.Object, 2)
            given[0], given[1] = option, percent
            kind.getMethod("setVMOption", text).invoke(bean, given)
    except Exception:  # another JVM may not have them; its own values still work
        return False
    return True


def build_session(master: str | None = None, app_name: str = "skyledger",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set to shared storage by whoever launches the job.  Only a
    local-mode session (tests, single-machine runs) may fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="skyledger-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint location for staged tables (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def give_back_heap(spark: SparkSession) -> bool:
    """Collect the driver's heap if a step left more than ``HEAP_TAKEN`` or ``HEAP_USED`` of its bound; whether it did.

    A job of many steps leaves plans, listings and broadcasts of steps that are over; until they are collected the heap
    grows to its bound, and their broadcasts stay on the executors too.  A full collection returns the rest to the
    system.  What is live is about 100 MB, so large heaps never come to it."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    taken, bound = runtime.totalMemory(), runtime.maxMemory()
    if taken <= HEAP_TAKEN * bound and taken - runtime.freeMemory() <= HEAP_USED * bound:
        return False
    spark._jvm.java.lang.System.gc()
    return True


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a new folder of the shared scratch location and read back:
    later steps share the work, see its true size, and nothing stays in executor memory.  What planning and
    broadcasts left on the driver's heap is given back."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    give_back_heap(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
