"""Session helpers: a local session for tests and checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "ledgermesh") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The session's spark.checkpoint.dir wins; only where it is unset and everything runs
    on one machine (master local) a folder of this machine is made. On a cluster without
    one this is an error, as executors would each write to their own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgermesh-"))
    return named or sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are removed when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a result in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as the setting is read then


def stow(df: DataFrame) -> DataFrame:
    """The same for wide results: a compressed table in the shared folder, read back column by column.

    It stays until it is discarded, or the folder removed with the job, as nothing tells when its last reader is done.
    The shuffle files it was made from go as soon as it is written. Joins with it are sort-merge
    joins: the planner takes the compressed size for that in memory and would broadcast too much.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def discard(*stowed: DataFrame) -> None:
    """Remove the tables of `stow` that these results read, once nothing reads them any more."""
    for df in stowed:
        spark = df.sparkSession
        jvm, home = spark._jvm, shared_dir(spark).rstrip("/")
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            folder = jvm.org.apache.hadoop.fs.Path(home)
            if path.getName().startswith("table-") and path.getParent().toUri().getPath() == folder.toUri().getPath():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
