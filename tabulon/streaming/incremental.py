"""Resumable tablizing of a landing folder (S8 as a stream).

The reference skips files whose outputs already exist.  With Structured
Streaming the file source's checkpoint records which files were consumed,
so each run (``availableNow``) processes only new files, and a run that dies
half-way is retried from the last committed micro-batch.  Each micro-batch
is tablized with the batch operators and appended to the output tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tablize as T


def tablize_landing_folder(spark: SparkSession, landing: str, out: str, checkpoint: str,
                           glob: str = "*", max_files_per_trigger: int | None = None) -> None:
    """Tablize every text file that arrived in ``landing`` since the last
    run; cells go to ``out/cells``, failures to ``out/errors``, each with a
    partition column ``epoch`` (the micro-batch)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(landing).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"file_id=([^/]+)/", 1).alias("file_id"),
        F.col("value").alias("text"))

    def batch(df: DataFrame, epoch_id: int) -> None:
        if df.isEmpty():
            return
        r = T.tablize_delimited(df)
        # one folder per micro-batch: a retried batch replaces its own rows
        for name in ("cells", "errors"):
            r[name].write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch_id}")

    q = (files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def land_text_files(files: DataFrame, landing: str) -> None:
    """Write (file_id, text) rows as one text file per row under ``landing``
    (partitioned by file id so each file keeps its own name)."""
    files.select("file_id", "text").write.mode("append").partitionBy("file_id").text(landing)
