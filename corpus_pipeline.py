"""A training corpus from raw documents, in five stages, each by one operator of quarry.llm.

Each stage takes (spark, docs, sf_dir), where docs is what the one before kept, and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of documents.

1 language ID: documents whose language is rejected, or that have no letters, go. The models are learned from the labelled
  documents of this stage's input.
2 exact dedup: of equal texts, the row with the largest doc_id stays.
3 near-dedup: SimHash fingerprints of five-word shingles in pigeonhole blocks, with bands of min-hashes for pairs that blocks don't
  reach; of documents that then are at exact Jaccard similarity 0.8 or more, the one with the smallest doc_id stays.
4 mixing to target weights: every document stays; rows are dealt into the order of the mix and written in it.
5 byte-level BPE: ids, their number and digests of ids and decoded bytes, with the row's place in the mix (mix_slot, mix_place): files
  don't keep an order, and the place follows from the rows alone.

The stages handle nulls, empty and long texts, ties, empty tables and extra columns as their operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, langid, mixing, near_dedup
from quarry.llm.scratch import Scratch

VOCABULARY = "byte_bpe_50k.tiktoken"
KEEP = ("doc_id", "lang", "source")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.with_positions(docs, KEEP)
    return bpe.encode_documents(placed, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=(*KEEP, "mix_slot", "mix_place"), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Character models, shingle sets and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
