"""From raw documents to token ids: quality rules, line dedup, near-duplicates, benchmark
decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each stage's
result to the shared folder and reads it again, so a lost executor repeats one stage's tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm import bpe, decontaminate, linededup, quality, simhash
from pricewise.llm.common import table
from pricewise.session import materialize

#: The vocabulary of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines and of long single lines go; every document stays, perhaps with an empty text."""
    return linededup.deduplicated(docs, long_words=linededup.LONG_WORDS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (3-word shingles, at most 3 differing bits)."""
    return simhash.one_per_group(docs, size=3, radius=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digests of the ids and of the text decoded from them."""
    coded = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: XXH64 bit counts and Jensen-Shannon distances are not for SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
