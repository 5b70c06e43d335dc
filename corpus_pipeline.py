"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``:

1. quality: what the ranked score rejects goes;
2. near duplicates: of each group (five-word shingles, similarity 0.8) the smallest id stays;
3. secrets: every span becomes a mark, n_chars is the new length;
4. mixing: sources in their target weights, a row for each copy that is taken;
5. tokens: ids as little-endian unsigned 32-bit integers, their number, and digests of
   the ids and of the decoded bytes.

Every stage takes whole texts of any length and gives an empty table for an empty one.
A null text is scored, compared and encoded as an empty one and stays null until the
last stage; an empty one links with nothing and stays in the mix once. Rows with a null
id are treated as others but are nobody's near duplicates. Rows that repeat an id and text stay or go together; where
documents tie, the smallest id stays and keys go by id, size and a hash of the text. A
null source is one of its own. Columns beyond those of ``documents`` are kept as they
are by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import op2_ngram_jaccard, op3_quality, op6_secrets, op7_byte_bpe, op8_mixing
from loomgraph.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_ngram_jaccard.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_mixing.mix_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op7_byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("ids",))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: No SQL: learned scores, redaction and byte pairs; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
