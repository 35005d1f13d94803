"""Structured Streaming scorer (ST1).

Articles arriving on a stream are scored with a model fitted once on a batch
table.  Two ways, same result:

* ``score_stream``: the row-local vector form as a streaming DataFrame --
  stateless, append mode, no shuffle, no state store; the only join is a
  stream-static broadcast equi-join with the k-row cluster statistics.
* ``score_stream_to_table``: every micro-batch is scored with the long-form
  batch scorer inside ``foreachBatch`` and written to its own
  ``batch_id=<n>`` directory in overwrite mode, so a batch replayed after a
  failure replaces its earlier output instead of duplicating it.  This is
  the faster path for large articles (sparse arithmetic instead of dense
  per-row arrays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from credence.plans.detector import SCORE_COLUMNS, ClusterDetector


def score_stream(model: ClusterDetector, stream: DataFrame) -> DataFrame:
    """Streaming DataFrame of scores for ``stream(doc_id, title, text, ...)``."""
    return model.score_vectors(stream).select(*SCORE_COLUMNS)


def article_stream(spark: SparkSession, path: str, schema,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source; ``schema`` is required for streaming sources."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def run_to_table(scores: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Drain all available input of a streaming DataFrame into a parquet sink
    (exactly-once through the sink's commit log) and stop."""
    q = (scores.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def score_stream_to_table(model: ClusterDetector, stream: DataFrame, out_path: str,
                          checkpoint: str) -> StreamingQuery:
    """Score each micro-batch with the long-form scorer; drain and stop."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (model.score(batch).select(*SCORE_COLUMNS)
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
