"""Token counts of flat token files: a vectorised search for the end-of-document id.

A token file is a plain run of fixed-width little-endian ids, every document
followed by one separator id, without an index. The files are cut into blocks
of equal length; each block is read and searched for separators on its own. A
document that begins in one block and ends in another is put together by two
prefix scans over the short list of blocks of its file: the greatest separator
position before the block tells where its first document began, the number of
separators before it gives the ordinal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize, new_folder, open_folder, text_of

BLOCK_TOKENS = 1 << 22


def write_token_files(documents: DataFrame, vocabulary: str, separator: int, width: int = 2, folder: str | None = None) -> DataFrame:
    """Tokenise whole texts into token files, one per task, and say what lies where.

    Returns (file, ordinal, doc_id), written. A null or empty text is a document of
    no tokens; equal rows are documents of their own. ``vocabulary`` is a rank file
    that every executor can read. The text of a separator is ordinary text. A task
    that runs twice leaves a file that the list does not name.
    """
    folder = folder or new_folder(documents.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, ordinal, out = f"{uuid.uuid4().hex}.tok", 0, None
        end = np.array([separator], f"<u{width}").tobytes()
        for batch in batches:
            out = out or system.open_output_stream(f"{path}/{name}")
            for text in batch.column("text"):
                out.write(np.asarray(encode(text.as_py()), f"<u{width}").tobytes() + end)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(ordinal, ordinal + len(ids))), ids], names=["file", "ordinal", "doc_id"])
            ordinal += len(ids)
        if out:
            out.close()

    frame = documents.select("doc_id", text_of(documents).alias("text"))
    where = materialize(frame.mapInArrow(run, f"file string, ordinal long, doc_id {dict(documents.dtypes)['doc_id']}"))
    return where.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


_ENCODERS: dict = {}
#: Longer texts go to the encoder in pieces cut where a blank is followed by a letter, where its pattern always cuts too.
LONG_TEXT = 1 << 16


def _encoder(vocabulary: str):
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    encode = _ENCODERS[vocabulary]

    def whole(text: str) -> list[int]:
        if len(text) <= LONG_TEXT:
            return encode(text)
        out, at = [], 0
        while at < len(text):
            to = _cut(text, at + LONG_TEXT)
            out += encode(text[at:to])
            at = to
        return out

    return whole


def _cut(text: str, at: int) -> int:
    """The next place from ``at`` with a letter, one blank and a letter around it; else the end."""
    while 0 < at < len(text) - 1:
        at = text.find(" ", at)
        if at < 1 or at >= len(text) - 1:
            return len(text)
        if text[at - 1].isalpha() and text[at + 1].isalpha():
            return at
        at += 1
    return len(text)


def token_files(spark: SparkSession, folder: str, glob: str = "*.tok") -> DataFrame:
    """(file, bytes) of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def count_tokens(files: DataFrame, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the token files: file, ordinal, start, n_tokens.

    ``files`` has file and bytes. ``start`` is the position of its first token.
    Tokens after the last separator of a file are a document of their own; a file
    that ends in a separator, or is empty, has none there. A trailing part of an id
    raises an error.
    """
    blocks = files.select("file", "bytes").filter("bytes > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / F.lit(block_tokens * width)))))
    blocks = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 4, "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "block"))):
                if size % width:
                    raise ValueError(f"{file} ends inside a token")
                system, path = open_folder(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(min(block_tokens * width, size - block * block_tokens * width), block * block_tokens * width)
                ends = np.flatnonzero(np.frombuffer(data, f"<u{width}") == separator) + block * block_tokens
                last = (block + 1) * block_tokens * width >= size
                if last and (not len(ends) or ends[-1] != size // width - 1):
                    ends = np.append(ends, size // width)  # what follows the last separator
                starts = np.append(0, ends[:-1] + 1)[: len(ends)]  # the first is known only after the scan
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(ends), pa.string()), pa.array(np.full(len(ends), block)), pa.array(np.arange(len(ends))), pa.array(starts), pa.array(ends)],
                    names=["file", "block", "i", "start", "end"])

    found = materialize(blocks.mapInArrow(search, "file string, block long, i long, start long, end long"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("begun"))
    start = F.when(F.col("i") == 0, F.col("begun")).otherwise(F.col("start"))
    return found.join(scan, ["file", "block"]).select("file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))
