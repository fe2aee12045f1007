"""A local session with the settings that the tests and the bench use; on a cluster the submitted configuration holds."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "8m", "spark.log.level": "ERROR",
    }
    spark = SparkSession.builder.master(master).config(map=conf | more).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
