"""Scans: mail files, mailboxes, labelled folders and tables, snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.session import materialize, opened

#: Bytes and files of one task that reads files, and bytes that it hands on at once.
PART_BYTES = 64 << 20
PART_FILES = 5000
BATCH_BYTES = 8 << 20
LISTED = "path string, folder boolean, bytes long"


def _is_hidden(name: str) -> bool:
    """As Spark's own file sources see it."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below ``path`` whose name matches ``pattern``, without hidden and
    empty ones, as Spark's own file sources list them.

    A level of folders is listed by a job, its rows stay with the tasks: the driver never
    holds more than the paths that ``path`` itself stands for.
    """
    from pyarrow import fs

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    roots = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not roots:
        raise FileNotFoundError(path)
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = re.compile(matches, re.S)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, base = opened(folder)
                prefix = folder[:len(folder) - len(base)]
                inside = [x for x in system.get_file_info(fs.FileSelector(base)) if not _is_hidden(x.base_name)]
                kept = [x for x in inside if x.type == fs.FileType.Directory or name.fullmatch(x.base_name)]
                yield pa.RecordBatch.from_pydict({"path": pa.array([prefix + x.path for x in kept], pa.string()), "folder": pa.array([x.type == fs.FileType.Directory for x in kept], pa.bool_()),
                                                  "bytes": pa.array([x.size or 0 for x in kept], pa.int64())})

    first = [(x.getPath().toString(), x.getPath().getName(), x.isDirectory(), x.getLen()) for x in roots]
    level = spark.createDataFrame([(at, folder, size) for at, name, folder, size in first if folder or not _is_hidden(name) and re.compile(matches, re.S).fullmatch(name)], LISTED)
    found = []
    while True:
        found.append(level.filter("NOT folder AND bytes > 0").select("path", "bytes"))
        folders = level.filter("folder").select("path")
        n = folders.count()
        if n == 0:
            return reduce(DataFrame.unionByName, found)
        level = materialize(folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, LISTED))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a directory tree, listed and read by tasks."""
    listed = list_files(spark, path, pattern)
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size.n, spark.sparkContext.defaultParallelism), -(-size.bytes // PART_BYTES), -(-size.n // PART_FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, held = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, base = opened(name)
                with system.open_input_stream(base) as file:
                    paths.append(name)
                    contents.append(file.readall())
                held += len(contents[-1])
                if held >= BATCH_BYTES or len(paths) >= 10_000:
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})
                    paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})

    return listed.select("path").repartition(tasks).mapInArrow(run, "path string, content binary")


def read_mail_files(spark: SparkSession, path: str, pattern: str = "*.{eml,txt}") -> DataFrame:
    """One row per file of a directory tree: (path, raw). Bytes that are not
    UTF-8 are dropped."""
    files = read_files(spark, path, pattern)
    # invalid bytes decode to the replacement character, which is taken out
    return files.select("path", F.replace(F.make_valid_utf8(F.decode_bytes(F.col("content")) if hasattr(F, "decode_bytes")
                                                            else F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("raw"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """One row per mail of mbox files: (path, raw), envelope line removed."""
    chunks = spark.read.option("lineSep", "\nFrom ").text(path).withColumn("path", F.col("_metadata.file_path"))
    # the first chunk of a file keeps 'From ', the others lost it with the separator
    body = F.regexp_replace(F.col("value"), r"^(?:From )?[^\n]*\n", "")
    return chunks.select("path", F.regexp_replace(body, r"(?m)^>(>*From )", "$1").alias("raw")).filter("raw <> ''")


def read_labelled_folders(spark: SparkSession, path: str, labels: dict[str, str], charset: str = "ISO-8859-1") -> DataFrame:
    """One row per file: (path, label, raw), the label taken from the name of
    the folder that holds the file. Files of other folders are left out."""
    files = read_files(spark, path)
    folder = F.element_at(F.split(F.col("path"), "/"), -2)
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    df = files.select("path", F.try_element_at(names, folder).alias("label"), F.decode("content", charset).alias("raw"))
    return df.filter("label IS NOT NULL")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Data must contain the columns: {', '.join(missing)}")
    return df


def read_labelled_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """CSV with quoted multi-line texts; the named columns must exist."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return require_columns(df, text, label)


CANONICAL = ["subject", "sender", "recipient", "date", "body", "is_phishing"]
# column-name parts in order of precedence
COLUMN_HINTS = [
    ("body", ("body", "content", "text")), ("is_phishing", ("label", "class", "phishing")), ("subject", ("subject",)),
    ("sender", ("from", "sender")), ("recipient", ("to", "recipient")), ("date", ("date",)),
]


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Canonical name -> source column, judged by parts of the column names;
    a later column replaces an earlier one."""
    found: dict[str, str] = {}
    for column in columns:
        low = column.lower()
        for name, hints in COLUMN_HINTS:
            if any(h in low for h in hints):
                found[name] = column
                break
    return found


def to_canonical(df: DataFrame, is_phishing: bool, compat: bool = False) -> DataFrame:
    """Any corpus table as (subject, sender, recipient, date, body, is_phishing).

    Without a body column the first column is the body. A row's own label wins
    over the corpus label; ``compat`` labels every row of a text/label table of
    a phishing corpus 1.
    """
    default = F.lit(1 if is_phishing else 0)
    if {"text", "label"} <= set(df.columns):
        found = {"body": "text", "is_phishing": "label"}
        own = not (compat and is_phishing)
    else:
        found, own = resolve_columns(df.columns), True
    # an empty body falls back to the first column as a missing one does
    first = F.col(f"`{df.columns[0]}`").cast("string")
    body = F.coalesce(F.nullif(F.col(f"`{found['body']}`").cast("string"), F.lit("")), first) if "body" in found else first

    def text(name: str) -> Column:
        return F.col(f"`{found[name]}`").cast("string") if name in found else F.lit("")

    label = F.coalesce(number_label(F.col(f"`{found['is_phishing']}`")), default) if own and "is_phishing" in found else default
    return df.select(*[text(n).alias(n) for n in CANONICAL[:4]], body.alias("body"), label.cast("int").alias("is_phishing"))


def number_label(label: Column) -> Column:
    """0/1 of a numeric, boolean or named label; null when it says nothing."""
    low = F.lower(F.trim(label.cast("string")))
    return F.when(low.isin("1", "1.0", "true", "phishing", "spam", "phish"), 1).when(
        low.isin("0", "0.0", "false", "legitimate", "ham", "ok"), 0)


REPUTATION = T.StructType([
    T.StructField("domain", T.StringType()), T.StructField("reputation_score", T.DoubleType()), T.StructField("blacklisted", T.BooleanType()),
    T.StructField("blacklist_count", T.IntegerType()), T.StructField("sources", T.StringType()), T.StructField("ord", T.IntegerType())])
HISTORY = T.StructType([
    T.StructField("sender", T.StringType()), T.StructField("recipient", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("subject", T.StringType()), T.StructField("is_phishing", T.IntegerType()), T.StructField("origin_ip", T.StringType()),
    T.StructField("origin_country", T.StringType())])


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """Reputation CSV. ``ord`` is the rank of a domain's rows, 1 when absent."""
    df = spark.read.option("header", "true").csv(path)
    require_columns(df, "domain", "reputation_score", "blacklisted", "blacklist_count", "sources")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(1).alias(f.name) for f in REPUTATION]
    return df.select(*typed)


def read_history(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Communication history; columns an older file lacks come back null."""
    df = spark.read.option("header", "true").csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    require_columns(df, "sender", "recipient", "timestamp")
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in HISTORY])


EXAMPLES = T.StructType([T.StructField("examples", T.ArrayType(T.StructType([
    T.StructField("content", T.StringType()), T.StructField("is_phishing", T.BooleanType()), T.StructField("explanation", T.StringType())])))])


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Example mails from nested JSON files."""
    return spark.read.schema(EXAMPLES).option("multiLine", "true").json(path).select(F.inline("examples"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
