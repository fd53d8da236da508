"""Continuous search service as a Structured Streaming job.

The reference answers queries one at a time (interactive prompt, HTTP
endpoint).  Here queries arrive as files of JSON lines {query_id, query} in
a folder; every micro-batch is searched as one batch (fuzzy search against
a prebuilt corpus) and written to ``out_dir/batch_id=<n>`` with overwrite,
so a replayed batch after a failure rewrites the same partition
(idempotent sink).  Progress lives in the checkpoint folder, so the job
resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.search import Corpus, fuzzy_search
from ..session import ensure_checkpoint_dir

QUERY_SCHEMA = "query_id long, query string"


def start_search_stream(spark: SparkSession, corpus: Corpus, query_dir: str, out_dir: str,
                        k: int = 10, checkpoint: str | None = None, available_now: bool = False,
                        max_files_per_trigger: int = 100) -> StreamingQuery:
    if checkpoint is None:
        checkpoint = ensure_checkpoint_dir(spark).rstrip("/") + "/search-stream"
    stream = (spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(query_dir))

    def run(batch: DataFrame, batch_id: int) -> None:
        hits = fuzzy_search(corpus, batch.where(F.col("query").isNotNull()), k)
        hits.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
