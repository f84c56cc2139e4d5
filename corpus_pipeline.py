"""From raw documents to token ids, in stages: each works on all that the one before kept.

All but the last return the columns of documents. The last returns doc_id, n_tokens, ids (array<int>) and ids_sha256.
Language models are learned from the documents given, benchmark items come from sf_dir. run() writes what each stage keeps to the
shared folder, so that no stage is computed again for a later one.

Null texts and those without a letter go in the first stage. Of repeated rows (one id, or none, and one text) one stays; rows with
one id and different texts are different documents. Texts that are all repeats stay, empty. Ties between copies go to the
least id. Empty tables give empty tables; extra columns of any name stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import bpe, decontaminate, jaccard_join, lang_id, registry, substring_dedup
from tallyrook.llm.shared import written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    return lang_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller id are cut out."""
    return substring_dedup.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), *registry.ranks())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


STAGES = [
    ("language_id", identify_languages),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: Learned language models and a byte-pair encoder are beyond SQL: a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
