"""Other sources and sinks: call logs, spans and records as JSON, Arrow and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_SCHEMA = (
    "call_type string, model string, system_chars bigint, user_chars bigint, response_chars bigint, latency_ms bigint, "
    "token_usage struct<input_tokens:bigint,output_tokens:bigint,estimated_cost_cents:bigint>, success boolean, error_kind string, error_message string, timestamp string"
)


def read_call_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Calls of JSON-lines logs; lines that aren't JSON objects are skipped. With ``last``, the latest
    calls by timestamp."""
    calls = spark.read.schema(CALL_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return calls if last is None else calls.orderBy(F.desc("timestamp")).limit(last)


def append_call_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def write_records(records: DataFrame, path: str, form: str = "parquet") -> None:
    """Records as parquet, JSON lines or CSV (nested columns as JSON text in CSV)."""
    out = records
    if form == "csv":
        nested = [c for c, t in records.dtypes if t.startswith(("map", "array", "struct"))]
        out = records.withColumns({c: F.to_json(c) for c in nested})
        out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        return
    out.write.mode("overwrite").format(form).save(path)


def to_arrow_file(df: DataFrame, path: str, max_rows: int) -> int:
    """An Arrow IPC file of a result of known, small size (the rows pass through the driver, so more
    than ``max_rows`` are refused); large results are written with ``write_records``."""
    import pyarrow as pa

    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return table.num_rows


def store_layouts(layouts: DataFrame, path: str) -> None:
    """Replace the table of known layouts, split by cache version so that the version gate prunes files."""
    layouts.write.mode("overwrite").partitionBy("cache_version").parquet(path)


def remove_layouts(spark: SparkSession, path: str, to: str, gone: DataFrame) -> None:
    """The table without some layouts, written to a new place."""
    spark.read.parquet(path).join(gone.select("layout_id").distinct(), "layout_id", "left_anti").write.mode("overwrite").partitionBy("cache_version").parquet(to)


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, fields, kv) of PDF files that have a ``<stem>.ground_truth.json`` beside them."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.ground_truth\.json|\.pdf)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(stem.alias("stem"), "path")
    truth = spark.read.schema("fields array<string>, kv array<array<string>>").option("multiLine", True).option("pathGlobFilter", "*.ground_truth.json").json(folder)
    truth = truth.withColumn("path", F.input_file_name()).select(stem.alias("stem"), "fields", "kv")
    return files.join(truth, "stem")
