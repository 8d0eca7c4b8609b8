"""A corpus pipeline: language ID, near-duplicate removal, mixing, packing; each stage reads what the last one kept.

Identified documents stay (``und`` goes, and so does a text in another language than its label), one document of each SimHash
group stays, sources are mixed to their target weights (a document may stay twice), and the mix is packed into
sequences.  Every stage returns the columns of ``documents`` but the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import langid, mixing, packing, simhash
from churnlens.llm.common import read_table, stored
from churnlens.llm.queries import tokenizer_file

#: A text whose cosine with every learned language is lower is rejected: none but ``und``, as a short text's cosine
#: is no larger than the noise of the profiles.
LEAST_SCORE = 0.0
#: A label is contradicted by a text of at least this cosine with another language; short texts, whose language is
#: less sure, do not reach it.
CONTRADICTS = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified_documents(docs, LEAST_SCORE, CONTRADICTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2)


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources),
          ("packing", pack)]

#: Profiles, SimHash and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
