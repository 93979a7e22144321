"""Tables in the shared folder at which long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a word or a few that every executor may hold.
SMALL = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a local one for a local session, as in tests, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = tempfile.mkdtemp(prefix="markovmill-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, folders: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages start there, whatever executors are lost.

    The files go when the driver ends, or with release(). folders: a column by whose values files are parted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/markovmill/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(folders) if folders else writer).parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def sent_if_small(df: DataFrame, by: DataFrame | None = None, most: int = SMALL) -> DataFrame:
    """df, to be sent to every executor if it (or `by`, which has as many rows at least) has at most that many rows. Counting a cut table is
    cheap; a larger one is joined as the session decides."""
    return F.broadcast(df) if (df if by is None else by).count() <= most else df


def release(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that cut() has returned, once nothing reads them any more."""
    for df in frames:
        if df is not None:
            files, at = _files(df.sparkSession, df.cut_path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
