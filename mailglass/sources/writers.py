"""Sinks: reports, detection log, history, corpora, vector table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files in a folder of :func:`write_files`, about.
PER_FOLDER = 2000


def report_rows(results: DataFrame) -> DataFrame:
    """CSV form of scored mails: factors joined by '; ', times with three
    decimals, failed rows left out."""
    return results.filter("error IS NULL").select(
        "file", "risk_score", F.array_join("risk_factors", "; ").alias("risk_factors"),
        F.format_string("%.3f", F.col("analysis_time")).alias("analysis_time"))


def report_summary(results: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return results.agg(
        F.count("*").alias("total_emails"), F.count_if(ok & (F.col("risk_score") > 0.5)).alias("phishing_emails"),
        F.count_if(ok & (F.col("risk_score") <= 0.5)).alias("legitimate_emails"), F.count_if(~ok).alias("failed_emails"))


def write_reports(results: DataFrame, folder: str) -> None:
    """JSON detail and summary, CSV rows."""
    results.write.mode("overwrite").json(f"{folder}/detail")
    report_summary(results).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")  # a single row
    report_rows(results).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(f"{folder}/csv")


def append_detections(detections: DataFrame, path: str) -> None:
    """Append to the detection log, one folder per day."""
    detections.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def append_history(history: DataFrame, path: str) -> None:
    history.withColumn("month", F.date_format("timestamp", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One folder per source and split."""
    corpus.write.mode("overwrite").partitionBy("source", "split").parquet(path)


def save_vectors(table: DataFrame, path: str) -> None:
    """Vector table with its metadata map; a new path per version, so that a
    table is never overwritten while it is read."""
    table.write.mode("errorifexists").parquet(path)


def write_files(df: DataFrame, path: str, name: Column, text: Column) -> int:
    """A text file for each distinct ``name``, its rows a line each; returns the number of files.

    Names are dealt to numbered folders, whose number grows with the rows, and may
    name a folder inside. Tasks write where the files stay, so that no step goes
    over all files one by one; a retry writes the same files again.
    """
    from pyarrow import fs

    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    rows = df.select(name.alias("name"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    folders = max(1, -(-df.count() // PER_FOLDER))
    rows = rows.withColumn("folder", F.pmod(F.xxhash64("name"), F.lit(folders)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(top)
        made, last, out, n = set(), None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                file = f"{base}/folder={batch.column(0)[i].as_py()}/{batch.column(1)[i].as_py()}"
                if file != last:
                    if out is not None:
                        out.close()
                    parent = file.rpartition("/")[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    out, last, n = system.open_output_stream(file, buffer_size=1 << 16), file, n + 1
                out.write(batch.column(2)[i].as_buffer())
                out.write(b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    dealt = rows.select("folder", "name", "text").repartition("folder", "name").sortWithinPartitions("folder", "name")
    return dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0
