"""Session helpers: table access and intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder. A
    machine-local folder is made only where neither is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage and
    survives the loss of executors. The files go when the driver ends, or with ``forget``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all intermediate tables written so far; frames that read them can't be used any more."""
    sc = spark.sparkContext
    while _written:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; what else goes wrong with it is raised."""
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(sc._jsc.hadoopConfiguration()).exists(hpath)


def replace_table(df: DataFrame, path: str, partition_by: str) -> None:
    """Write ``df``, which may be read from ``path``, in its place: beside it first, so that the old table is
    there until the new one is whole."""
    sc = df.sparkSession.sparkContext
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.partitionBy(partition_by).parquet(new)
    old, fresh = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    fs = old.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(fresh, old):
        raise OSError(f"{new} could not be renamed to {path}")


def broadcast_if_small(df: DataFrame, max_rows: int, counted: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within ``max_rows``; otherwise the
    plan keeps its shuffle join. ``df`` must be cheap to count (a written table)."""
    from pyspark.sql import functions as F

    n = df.count() if counted is None else counted
    return F.broadcast(df) if n <= max_rows else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python operators find it there
    whatever folder the job was started from. The archive is handed over by Spark's own file server."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_folioscope_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="folioscope-package-"), "folioscope_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._folioscope_shipped = True
