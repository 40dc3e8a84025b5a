"""New files as a stream: each PDF once, in batches, with dead letters for those that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from folioscope.operators import extract
from folioscope.operators import layout
from folioscope.sources import pdf

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, files_per_batch: int = 100, recursive: bool = True) -> DataFrame:
    """PDF files as they come; the source's log keeps every path from being read twice, across restarts too."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", recursive).option("maxFilesPerTrigger", files_per_batch).load(folder)
    )


def watch(
    spark: SparkSession, folder: str, out: str, checkpoint: str, schema_json: str = "{}", files_per_batch: int = 100, available_now: bool = False
) -> StreamingQuery:
    """Extract every new file by a schema: records to ``out/records``, failures to ``out/failures``.

    A batch that runs again after a failure overwrites its own output, so nothing is doubled."""

    def process(batch: DataFrame, number: int) -> None:
        rows = pdf.parse_files(batch).persist()
        spans = rows.where("error IS NULL").drop("error").withColumn("doc_id", F.xxhash64("path"))
        names = spans.select("doc_id", "path").distinct()
        records = extract.records(spans.drop("path"), schema_json).join(layout.layout_ids(spans), "doc_id").join(names, "doc_id")
        flat = records.withColumns({c: F.to_json(c) for c in ("fields", "arrays", "confidence")})
        flat.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        failures = rows.where("error IS NOT NULL").select("path", F.lit("ingestion").alias("stage"), "error")
        failures.write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        rows.unpersist()

    writer = new_files(spark, folder, files_per_batch).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


class Progress(StreamingQueryListener):
    """Counts of a running stream, for whoever reports progress."""

    def __init__(self) -> None:
        self.batches, self.rows, self.ended = 0, 0, False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended = False

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True
