"""Micro-batch run logging.

The reference appends each query's ranked list to the run file as soon as
the query is answered. The same, as Structured Streaming: completions
arriving in a folder (parquet) are extracted, ranked (RK1 — a narrow,
stateless step) and appended to the run's parquet table per micro-batch.
No state is kept, so no watermark is needed; the checkpoint location makes
the sink exactly-once across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extractor as extractor_fn
from ..operators.runs import to_run

COMPLETIONS_SCHEMA = "query_id string, completion string"


def stream_runs(spark: SparkSession, completions_dir: str, out_dir: str, checkpoint_dir: str,
                run_id: str, extractor: str = "list", lead: str = '["',
                trigger_once: bool = True) -> StreamingQuery:
    """Start a query turning new completion files into run rows."""
    src = spark.readStream.schema(COMPLETIONS_SCHEMA).parquet(completions_dir)
    runs = to_run(src.withColumn("suggestions", extractor_fn(extractor, lead)(F.col("completion"))),
                  run_id=run_id)
    w = (runs.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def ranked(completions: DataFrame, run_id: str, extractor: str = "list", lead: str = '["') -> DataFrame:
    """The per-batch transformation, usable on static frames as well."""
    return to_run(completions.withColumn("suggestions", extractor_fn(extractor, lead)(F.col("completion"))),
                  run_id=run_id)
