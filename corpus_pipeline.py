"""From raw documents to packed batches, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns the columns of ``docs``; the last returns batches. Between
stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.llm import chosen_path, language_id, packing, quality
from mailglass.llm.queries import ACCEPT, MAX_EPOCHS, domain, held_out, mixed, table
from mailglass.llm.shared import materialize

#: Documents have no other stage in SQL: trained models and sketches decide (see tests/llm).
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those between two languages, go."""
    model = language_id.fit(docs, ~held_out(4, 2))
    named = language_id.identify(docs, model)
    return named.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("lang_ambiguous")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below the query's threshold go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.fit(docs, labels, ~held_out(4, 2))
    return quality.score(docs, weights).filter(F.col("quality_score") >= ACCEPT).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the text with the smallest doc_id stays.

    Rows are told apart by doc_id and text, so of two texts under one doc_id one may go
    and the other stay; of rows that share both, one stays. Texts without words stay, and
    so do rows without a doc_id.
    """
    marked = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = chosen_path.near_duplicates(marked, keep=["_digest"]).filter("doc_id IS NOT NULL")
    # what goes, and what is there more than once: the rest need not be touched
    known = materialize(judged.groupBy("doc_id", "_digest").agg(F.min("kept").alias("_kept"), F.count("*").alias("_n")).filter("NOT _kept OR _n > 1"))
    left = marked.join(known, ["doc_id", "_digest"], "left").filter("_kept IS NULL OR _kept")
    again = left.filter("_n > 1").dropDuplicates(["doc_id", "_digest"])
    return left.filter("_n IS NULL OR _n = 1").unionByName(again).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, by the weights of the tree; a text taken in k epochs is k rows."""
    taken = mixed(spark, docs.withColumn("_domain", domain()), F.floor(F.col("capacity") / MAX_EPOCHS), "_domain")
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of pieces of whole texts, by length."""
    return packing.batches(packing.pack(docs))


STAGES = [
    ("language_id", keep_languages),
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
