"""From raw documents to packed token sequences, one stage after the other.

Each stage takes the rows that the one before has kept. All but the last return
the columns of ``documents``, and others that the table has; the last returns
pieces of packed sequences.

Defined results: an empty table stays empty through all stages; rows with a null
id are kept like others and are one document to the quality stage; rows that
repeat an id share the quality result, and of these the duplicate stage keeps
one; ``n_chars``, where there is one, counts the characters of the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.cost_packing import pack_by_cost
from cladewise.llm.kneser_ney import filter_quality
from cladewise.llm.minhash import drop_near_duplicates
from cladewise.llm.mixing import mixed_documents
from cladewise.llm.pii import redact
from cladewise.llm.scratch import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high for their language. Null texts and those without words go."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id. Documents without words or id stay."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. Null texts stay null; no row goes."""
    return _counted(redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the last of a pass in part. A null source is one like others; texts without words go."""
    return _counted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced sequences; a text without tokens is one piece, its end token."""
    pieces = pack_by_cost(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: Models, hashes and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.save(out)
    return docs
