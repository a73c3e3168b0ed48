"""From raw documents to token files: the stages of the corpus pipeline.

Every stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm.bitplanes import token_table, word_tokenizer
from episodica.llm.common import prepare
from episodica.llm.entropy_mix import mixed_documents
from episodica.llm.jaccard import one_of_each
from episodica.llm.weak_supervision import quality_filter
from episodica.llm.wu_manber import drop_contaminated
from episodica.plans.small import keep


#: the same Python workers serve all stages beside a JVM that has grown, so they get small batches
BATCH_BYTES = 4 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    prepare(spark, BATCH_BYTES)
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    prepare(spark, BATCH_BYTES)
    return one_of_each(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    prepare(spark, BATCH_BYTES)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for."""
    prepare(spark, BATCH_BYTES)
    return mixed_documents(docs, (5.0, 2.0, 1.0), 3.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed planes, read back: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark, BATCH_BYTES)
    return token_table(spark, docs, word_tokenizer(), end_id=1, cached_words=150_000)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token ids", token_files),
]

#: EM, Newton steps and a tokenizer have no SQL form; the tests hold a brute-force version against the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
