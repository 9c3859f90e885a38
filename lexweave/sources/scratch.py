"""Tables that are written once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """A path of Hadoop's, and its file system."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, fs = file_system(spark, path)
    return fs.exists(made)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written by the driver."""
    made, fs = file_system(spark, path)
    stream = fs.create(made, True)
    stream.write(bytearray(content))
    stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (where that is unset: in a temporary folder under a local master, in the
    warehouse if that is not the driver's own file system), in a folder that goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + (folder := tempfile.mkdtemp(prefix="lexweave-"))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        elif not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if urlparse(base).scheme in ("", "file"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _folders[app] = f"{base.rstrip('/')}/lexweave-tables-{app}"
        made, fs = file_system(spark, _folders[app])
        fs.mkdirs(made)
        fs.deleteOnExit(made)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*kept: DataFrame) -> None:
    """Deletes what keep() wrote for these, which nothing reads any more, and has the driver collect its garbage, without which
    Spark leaves on disk the shuffles that made them."""
    for df in kept:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            made, fs = file_system(spark, folder)
            fs.delete(made, True)
        spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame, name: str) -> DataFrame:
    """keep(), without the shuffles that made it: those stay on disk until the driver has collected its garbage."""
    kept = keep(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return kept
