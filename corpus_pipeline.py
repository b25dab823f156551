"""The corpus pipeline: from raw documents to token ids, stage by stage.

Each stage takes what the one before it kept, written as Parquet and read again, and its decisions take effect:
toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark passages go,
personal data is replaced, and the texts are encoded. All stages but the last return the columns of documents.

Defined results of every stage: rows are known by a number of their own, so null and repeated keys lose or keep no
other row. A null or empty text scores as clean, has no near copies, no benchmark passages and no personal data, and
encodes to no tokens. Of equal rows, with or without a key, one stays. Further columns are carried along whatever
their names; the last stage replaces columns named `ids` or `n_tokens`. An empty table gives an empty table (the
toxicity stage needs labels of both classes for its documents).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe.llm import byte_bpe, decontamination, near_dup, pii, toxicity
from labframe.llm.common import broadcast_if_small, discarded, documents, stored


#: The column that holds a row's number while a stage runs.
ROW = "pipeline row number"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a stored number for each row, as doc_id may be null or repeated."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, which are numbered, but the given rows (broadcast only if counted and few), and without the numbers."""
    return docs.join(broadcast_if_small(stored(rows.select(ROW).distinct(), "gone")), ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; learnt from the labelled ones."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, of those with the least doc_id, on shingles of five words; rows without doc_id come last."""
    rows = numbered(docs)
    found = stored(near_dup.near_duplicates(rows, id_column=ROW).select(ROW, "component_id").join(rows.select(ROW, "doc_id"), ROW), "found")
    groups = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"), F.count("*").alias("n"))
    stays = stored(groups.where("n > 1").select("component_id", F.col("first")[ROW].alias("stays")), "stays")
    return without(rows, found.join(broadcast_if_small(stays), "component_id").where(F.col(ROW) != F.col("stays")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with an occurrence of a window of a benchmark item."""
    rows = numbered(docs)
    return without(rows, decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=ROW).where("contaminated"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters anew, if the table has them."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text and their number."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", hide_personal_data), ("byte_bpe", encode)]

#: SQL can express neither the learnt scores nor the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, before, sf_dir), name)
        if i:
            discarded(before)
        before = docs
    return docs
