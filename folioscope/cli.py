"""Command line: python -m folioscope.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import config
from folioscope.operators import extract, layout, quality, runs
from folioscope.operators import spans as S
from folioscope.session import exists, forget, materialize, replace_table
from folioscope.sources import pdf, tables
from folioscope.streaming import watch as stream


def _spans(spark: SparkSession, folder: str, settings: config.Settings) -> tuple[DataFrame, DataFrame]:
    rows = materialize(pdf.parse_files(pdf.list_files(spark, folder)), "parsed")  # the files are parsed once
    good = rows.where("error IS NULL").drop("error").withColumn("doc_id", F.xxhash64("path"))
    good = S.truncate(good, settings.max_spans) if settings.max_spans else good
    return good, rows.where("error IS NOT NULL").select("path", F.lit("ingestion").alias("stage"), "error")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in (("extract", ("input", "out")), ("batch", ("input", "out")), ("grid", ("input", "out")), ("ingest", ("input",)), ("classify", ("input", "out")), ("status", ()), ("watch", ("input", "out")), ("benchmark", ("input",)), ("cache", ("action",))):
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(n)
        c.add_argument("--layouts")
        c.add_argument("--schema", default="{}")
        c.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
        c.add_argument("--layout-id")
        c.add_argument("--once", action="store_true")
    a = p.parse_args(argv)
    settings = config.load(a.config, cache_dir=a.layouts)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command in ("extract", "batch"):
        spans, failures = _spans(spark, a.input, settings)
        records = extract.records(spans.drop("path"), a.schema).join(spans.select("doc_id", "path").distinct(), "doc_id")
        tables.write_records(records, f"{a.out}/records", a.format)
        tables.write_records(failures, f"{a.out}/failures", a.format)
        print(json.dumps({"failed": spark.read.format(a.format).load(f"{a.out}/failures").count() if a.format != "csv" else failures.count()}))
    elif a.command == "grid":
        spans, _ = _spans(spark, a.input, settings)
        lines = S.grid_lines(spans, settings.x_bucket, settings.y_bucket).join(spans.select("doc_id", "path").distinct(), "doc_id")
        tables.write_records(lines.orderBy("path", "row_no"), a.out, a.format)
    elif a.command == "classify":
        pages = pdf.parse_files(pdf.list_files(spark, a.input), "pages").where("error IS NULL").withColumnRenamed("path", "doc_id").drop("error")
        tables.write_records(quality.classify_pages(pages), a.out, a.format)
    elif a.command == "ingest":
        spans, _ = _spans(spark, a.input, settings)
        ids = layout.layout_ids(spans).groupBy("layout_id").agg(F.count("*").alias("n_docs"))
        if exists(spark, settings.cache_dir):
            ids = ids.join(spark.read.parquet(settings.cache_dir).select("layout_id"), "layout_id", "left_anti")
        new = materialize(ids.withColumn("cache_version", F.lit(layout.CACHE_VERSION)), "new-layouts")
        new.write.mode("append").partitionBy("cache_version").parquet(settings.cache_dir)
        print(json.dumps({"new_layouts": new.count()}))
    elif a.command == "cache":
        known = spark.read.parquet(settings.cache_dir)
        if a.action == "list":
            for row in known.orderBy("layout_id").toLocalIterator():  # all of them, one partition at a time
                print(json.dumps(row.asDict()))
        elif a.action in ("delete", "clear"):
            keep = known.where(~F.col("layout_id").eqNullSafe(a.layout_id)) if a.action == "delete" else known.limit(0)
            kept = materialize(keep, "kept-layouts")
            replace_table(kept, settings.cache_dir, "cache_version")
            print(json.dumps({"kept": kept.count()}))
    elif a.command == "status":
        print(json.dumps(settings.__dict__, default=list))
    elif a.command == "watch":
        q = stream.watch(spark, a.input, a.out, f"{a.out}/checkpoint", a.schema, settings.batch_size, a.once)
        q.awaitTermination()
    elif a.command == "benchmark":
        began = time.perf_counter()
        spans, _ = _spans(spark, a.input, settings)
        n = extract.records(spans.drop("path"), a.schema).count()
        took = time.perf_counter() - began
        times = runs.latency_by_index(pdf.parse_times(pdf.list_files(spark, a.input)).withColumn("all", F.lit("all")), "all", "ms").collect()
        per_file = {k: round(times[0][k], 3) for k in ("mean", "p50", "p95", "p99")} if times else {}
        print(json.dumps({"documents": n, "seconds": round(took, 3), "documents_per_second": round(n / took, 2), "ms_per_file": per_file}))
    forget(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
