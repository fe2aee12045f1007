"""The replies log as a stream: malformed lines dropped, repeated keys dropped, every new reply scored once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.triage import Scorer, reply_verdicts
from ..sources.readers import REPLY

KEY = ["prompt_id", "model", "condition"]


def new_replies(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of replies, each key once. State is kept by key, as the log has no event time; a campaign bounds it."""
    raw = spark.readStream.schema(REPLY).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.where(F.col("prompt_id").isNotNull()).dropDuplicates(KEY)


def score_stream(replies: DataFrame, scorer: Scorer, out: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of what is there, appended by batch; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        reply_verdicts(batch, scorer).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
