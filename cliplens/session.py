"""Session set-up, shared scratch folders and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "cliplens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, which run its functions in tasks.

    Not needed where it is installed on all machines or given by --py-files.
    """
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="cliplens-ship-")) / package.name), "zip",
        package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cliplens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


SMALL_SHARE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes from fewer and small files, else as it is.

    A table that is one small file would keep one core busy, and moving it is
    cheap. Nothing is run to find out.
    """
    spark = df.sparkSession
    cores, names = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(names) < cores:
        return df
    total = 0
    for name in names:
        store, where = _file_system(spark, name, encoded=True)
        total += store.getFileStatus(where).getLen()
    return df.repartition(cores) if total < cores * SMALL_SHARE else df


RUN_KEY = "spark.cliplens.run"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of this run, below the shared folder, never used before."""
    run = spark.conf.get(RUN_KEY, None)
    if not run:
        run = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
        spark.conf.set(RUN_KEY, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str, encoded: bool = False):
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path) if encoded else path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    store, where = _file_system(spark, path)
    return store.exists(where)


def end_run(spark: SparkSession) -> None:
    """Drop what this run has written to the shared folder; its results are unreadable then.

    The next scratch path starts a new run.
    """
    run = spark.conf.get(RUN_KEY, None)
    if run:
        store, where = _file_system(spark, run)
        store.delete(where, True)
        spark.conf.unset(RUN_KEY)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage like a checkpoint, survives lost executors, and gives the
    optimizer real file statistics. ``options`` go to the parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
