"""Incremental staging of raw dumps: landing folder → typed Parquet.

The batch staging step (``sources.sinks.stage_to_parquet``) re-reads the whole
landing folder every run. As a Structured Streaming job the same step only
reads files that arrived since the last run: the file source records processed
files in the query's checkpoint, and ``availableNow`` processes everything
present and then stops, so the job can run on a schedule like a batch job.
The checkpoint lives in the shared checkpoint folder, so a restarted driver or
a lost executor resumes without re-ingesting or dropping files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from castlens.session import scratch_path
from castlens.sources.readers import TSV_OPTIONS


def stage_stream(spark: SparkSession, landing_dir: str, schema: StructType | str, out_dir: str,
                 checkpoint_location: str | None = None, max_files_per_trigger: int | None = None,
                 partition_by: list[str] | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """Ingest all not-yet-staged files of ``landing_dir`` into Parquet at ``out_dir``.

    Runs one ``availableNow`` trigger (split into micro-batches of at most
    ``max_files_per_trigger`` files) and returns the staged table. Pass the
    same ``checkpoint_location`` (a shared folder) on every run to make the
    runs incremental; the default, a fresh folder, makes a one-off run.
    """
    opts = dict(TSV_OPTIONS) if sep == "\t" else {"sep": sep, "mode": "PERMISSIVE"}
    opts["header"] = "true" if header else "false"
    if max_files_per_trigger:
        opts["maxFilesPerTrigger"] = str(max_files_per_trigger)
    stream = spark.readStream.options(**opts).schema(schema).csv(landing_dir)
    ckpt = checkpoint_location or scratch_path(spark, "stage_stream_checkpoint")
    w = stream.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(schema).parquet(out_dir)
