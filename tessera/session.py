"""Session helpers: a tuned local session, reading tables, reading a key once, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "tessera", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a session, as --py-files would; once a session.

    The archive is served by the driver to every executor, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tessera_shipped = True


def read(spark: SparkSession, directory: str, table: str, *columns: str) -> DataFrame:
    """One Parquet table, with only the columns asked for."""
    ship(spark)
    df = spark.read.parquet(f"{directory}/{table}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *key: str) -> DataFrame:
    """Each key once. Repeated rows differ at most in columns that the caller has not selected."""
    return df.dropDuplicates(list(key))


def spread(df: DataFrame) -> DataFrame:
    """A plain scan over at least as many tasks as there are cores: small files alone would give costly work one task.

    A scan of enough partitions (any large table) is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once_known(df: DataFrame, *key: str) -> DataFrame:
    """Each key once, for tables whose repeated rows may lack values: a known value wins over null, the greatest over others."""
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in df.columns if c not in key])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir; a temporary one only where the master is local and none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or anything that a pattern names) is there, by the file system that the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def changed_at(spark: SparkSession, path: str) -> int:
    """When a path was last changed, in milliseconds; 0 if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(target).getModificationTime() if files.exists(target) else 0


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that are written and read again."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder all executors share and reads it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
