"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is what the cluster names in ``spark.checkpoint.dir``, with the scheme and host of its file
    system.  Only where that is unset and all runs on one machine (tests, a laptop) a temporary
    folder is made and set; elsewhere executors could not see it, so that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    target, files = _path(spark, base)
    whole = files.makeQualified(target).toString().rstrip("/")
    return re.sub("^file:/(?!/)", "file:///", whole)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: This application's folder below the shared one, by application.
_roots: dict[str, str] = {}


def own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, which goes when the application ends.

    Checkpoints go there too, unless the application has set another folder for them.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = shared_dir(spark)
        own = f"{base}/lodestone-{uuid.uuid4().hex}"
        root, files = _path(spark, own)
        files.mkdirs(root)
        files.deleteOnExit(root)
        _roots[app] = own
        now = context.getCheckpointDir()
        if now is None or re.sub("^file:/+", "/", now).startswith(re.sub("^file:/+", "/", base)):
            context.setCheckpointDir(f"{own}/checkpoints")
    return _roots[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below this application's own folder; nothing is created yet."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.mkdirs(target)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and forgets how it was made.

    A lost executor costs nothing: the rows are read again from the shared folder.
    """
    own_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """As ``cut``, but as Parquet, which is smaller for wide rows and lets columns be pruned."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    target, files = _path(spark, path)
    files.delete(target, True)
