"""Written tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


@atexit.register
def _sweep() -> None:
    """What is left on this machine's own disk goes with the process; on a cluster ``clear`` or the cluster's own rules remove it."""
    for path in _FOLDERS:
        if path.startswith("file:/"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset (tests, one machine), a new local folder becomes the setting; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lahja-")
        _FOLDERS.add(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Remove all tables that were written in this process; frames that read them can't be used any more."""
    for path in list(_FOLDERS):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _FOLDERS.discard(path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
