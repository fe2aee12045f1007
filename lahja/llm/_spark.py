"""Written tables in the folder that the cluster shares, and other small helpers."""

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
    """spark.checkpoint.dir of the session. Where it is unset (tests, one machine), a new local folder becomes the setting; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lahja-")
        _FOLDERS.add(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that operators wrote in this process; frames that read them can't be used any more."""
    for path in list(_FOLDERS):
        delete(spark, path)
        _FOLDERS.discard(path)


class Scratch:
    """Tables of one operator call. ``write`` cuts lineage with a written table; ``keep`` removes all but those that are still read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[int, DataFrame] = {}
        self.n = 0
        _FOLDERS.add(self.root)

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # a written table needs its shuffles no more; they go when the write ends, not when the driver collects garbage
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(name, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lahja_path = path
        self.tables[self.n] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for n, t in list(self.tables.items()):
            if any(t is x for x in tables):
                delete(self.spark, t._lahja_path)
                del self.tables[n]

    def keep(self, *tables: DataFrame) -> None:
        self.drop(*[t for t in self.tables.values() if not any(t is x for x in tables)])


def few_splits(df: DataFrame) -> bool:
    """Whether a table that is read has fewer splits than the cluster has cores: its few MB would keep a core or two busy."""
    return df._jdf.queryExecution().toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(io: Scratch, df: DataFrame) -> DataFrame:
    """A table that is read; one of few splits is written again in as many parts as there are cores, in a fixed order."""
    if not few_splits(df):
        return df
    again = io.write(df.repartition(df.sparkSession.sparkContext.defaultParallelism))
    io.drop(df)
    return again


def bytes_of(df: DataFrame) -> int:
    """Size of a written table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lahja_path)
    return int(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of no more rows than this, from here on in the session: the default suits narrow rows, not documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
