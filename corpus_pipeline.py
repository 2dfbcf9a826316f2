"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing, byte-level BPE.

Each stage works on all that the stage before it kept, written as Parquet and reread.
All but the last return the columns of documents; n_chars follows the text. Columns beyond those are
left out by the first stage; a table without rows passes through every stage as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, quality, simhash, substring
from millrace.llm.common import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them, as they have fewer than 20 words. Repeated rows are judged alike; a null language by the text's script."""
    return quality.filtered(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) the document with the smallest doc_id stays.

    Texts without a word are copies of each other. Rows of one doc_id are one document and stay or go together; rows without a doc_id stay.
    """
    gone = simhash.similar(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages (13 words or more) that a document with a smaller doc_id holds go; a text that loses none stays as it is, a null text too.

    A text that loses words is its kept words joined by one space, and may be left empty. Rows of one doc_id don't take words from each other;
    a null doc_id is larger than any other.
    """
    return substring.rewritten(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to 3 times; those without a word aren't taken. A null source is a source of its own. Rows that hash alike, repeated rows among them, are taken alike."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by what they decode to; a null text is empty, a repeated row is encoded again."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix_sources), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
