"""Session defaults. Cluster settings always win over these."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "mailglass", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Where ``spark.checkpoint.dir`` is unset, a local folder stands in for it, but
    only in a single-process session: elsewhere executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
    return tempfile.mkdtemp(prefix="mailglass-")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    Cuts the lineage of a frame that several later steps read, in a place that
    outlives any executor, and gives the planner its true size.
    """
    path = f"{shared_folder(df.sparkSession)}/mailglass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as tasks can open it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def opened(path: str):
    """A file system of Arrow and the path in it, of a path as Hadoop writes it."""
    from pyarrow import fs

    local = urlsplit(path).scheme in ("", "file")
    return (fs.LocalFileSystem(), path.removeprefix("file:")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@,=+-_.~"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt over all cores when it has fewer splits than
    cores, as a table in one small file has. Large inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
