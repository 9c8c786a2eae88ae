"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "trellis") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the launcher supplies the master and sizing; locally we pick
    ``local[*]`` and a shuffle width that matches the cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` wins. Only a local-mode
    session without one (tests, laptops) gets a fresh scratch folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="trellis-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before running")


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table into the shared checkpoint folder and
    read it back: the lineage ends here.

    Used where a result is read several times (the split before the fold
    loops and model fits, the distinct-score table of the curves), so each
    read scans a written columnar table -- with column pruning and real size
    statistics for the optimizer -- instead of recomputing upstream shuffles.
    A lost executor then only costs re-reading files from shared storage. The files are
    zstd (keys are hex digits), and the shuffles of the write go with its end.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    track(path)
    return spark.read.parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict = {"lock": threading.Lock(), "n": 0, "before": None}


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Queries that start inside delete their shuffle files when they end, not when the driver's JVM next happens
    to collect its garbage. The setting is put back when the last of several threads leaves."""
    with _writing["lock"]:
        if not _writing["n"]:
            _writing["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writing["n"] += 1
    try:
        yield
    finally:
        with _writing["lock"]:
            _writing["n"] -= 1
            if not _writing["n"]:
                if _writing["before"] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, _writing["before"])


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread writes inside are deleted at the end, but for those given to the yielded function. What is
    handed out must read no other ones."""
    outer, mine, kept = getattr(_scopes, "tables", None), [], set()
    _scopes.tables = mine

    def keep_table(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 2)[-2] for f in df.inputFiles())
        return df
    try:
        yield keep_table
    finally:
        _scopes.tables = outer
        for path in mine:
            if path.rsplit("/", 1)[-1] not in kept:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            elif outer is not None:
                outer.append(path)


def forget(*written: DataFrame) -> None:
    """Delete written tables once all that reads them has been written. They must not be read again."""
    for df in written:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def track(path: str) -> str:
    """Note a table that this process wrote, for ``release_tables``."""
    _WRITTEN.append(path)
    if getattr(_scopes, "tables", None) is not None:
        _scopes.tables.append(path)
    return path


_WRITTEN: list[str] = []
_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a small derived table that is read more than once (memory,
    spilling to disk). Unlike a local checkpoint it keeps its lineage, so
    blocks lost with an executor are recomputed."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release_tables(spark: SparkSession) -> int:
    """Delete the tables this process wrote with ``cut_lineage`` and drop the
    ones it persisted with ``keep``. DataFrames read from written tables
    become unusable, so call it once their results are saved."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _KEPT:
        _KEPT.pop().unpersist()
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n
