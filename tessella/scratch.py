"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Root folders of applications whose session names none, by application id.
_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine, as in tests, a temporary folder
    is made, one for each application; on a cluster its absence is an error, as executors share no
    temporary folder. The setting itself can't be changed once Spark runs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _roots:
            _roots[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        root = _roots[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared root; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/tessella/{tag}-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have gone first
        return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written, after which ``old``, a table of :func:`written` that nothing else reads, is removed."""
    out = written(df, tag)
    for file in old.inputFiles()[:1]:
        remove(old.sparkSession, file.rsplit("/", 1)[0])
    return out
