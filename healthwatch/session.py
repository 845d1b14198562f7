"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Reliable checkpoints of intermediate tables are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Long-running local sessions should not keep the event log on.
    "spark.eventLog.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "healthwatch",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC session time and no UI."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is honoured as is.
    Only when it is unset on a ``local`` master (tests) a fresh local folder
    is created and registered, so ``DataFrame.checkpoint()`` works the same in
    both places; on any other master executors would write to their own disks,
    so the missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="healthwatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


def write_table(df, name: str):
    """Cut lineage: write ``df`` once as parquet under the shared checkpoint
    folder (one job) and return a scan of it.  Unlike an eager RDD
    checkpoint this computes the input once, and later plans get column
    pruning and filter pushdown on the written table."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


#: Tables written by this process that were not removed yet.
_WRITTEN: list[str] = []


def remove_tables(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables this process wrote after the first ``keep`` ones, in
    whatever file system they are; returns how many went.  Results that still
    read them must be consumed before."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[keep:]
    del _WRITTEN[keep:]
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(gone)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Remove the intermediate tables written inside the block when it ends:

    ``with scratch_tables(spark): detect_all(...).write.parquet(out)``"""
    keep = len(_WRITTEN)
    try:
        yield
    finally:
        remove_tables(spark, keep)


@atexit.register
def _remove_at_exit() -> None:
    """Tables that nobody removed go with the application, while it still has
    a running context."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            remove_tables(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``healthwatch`` importable in the Python workers that run pandas
    functions (``applyInPandas``, ``mapInPandas``, ``applyInPandasWithState``).

    The package is zipped once per application and registered with
    ``addPyFile``, which distributes it to every executor.  The zip is
    written to the shared checkpoint folder when that is a local path,
    otherwise to the driver's scratch space, which Spark serves to the
    executors itself."""
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("healthwatch", os.path.relpath(full, pkg)))
    base = checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        base = tempfile.mkdtemp(prefix="healthwatch-pyfiles-")
    base = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(os.path.join(base, "pyfiles"), exist_ok=True)
    path = os.path.join(base, "pyfiles", f"healthwatch-{app}.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(app)
