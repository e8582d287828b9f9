"""From raw documents to token ids: five stages, each written as a table and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentweave.llm import bpe, decontam, langid, simhash, suffix
from rentweave.llm.common import bound_batches, keyed, stage, table

#: Encoded chunks that a worker of the last stage keeps, about 250 bytes each; its executor is large from the stages before.
KEEP_CHUNKS = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters, and texts in no learned language (too many bits a byte, or no clear winner).

    Learns from all rows with a text and a lang. Rows that repeat or share a doc_id are judged each by its text; kept rows are unchanged.
    """
    bound_batches(spark)
    return langid.accepted(docs, langid.fit(langid.training_sample(docs, F.col("doc_id").isNotNull())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, a null id last; repeated rows leave one. Texts without words (null, empty) are alike only to equal ones.
    """
    bound_batches(spark)
    return simhash.keep_one_of_each(docs, similarity=0.8, shingle=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of more than 50 words, or of 400 bytes, that also stands elsewhere out of the texts.

    All rows stay, with what is left of their text: a null text stays null, one that is all repeats ends empty.
    """
    bound_batches(spark)
    return suffix.cut_repeats(docs, 400, passage=51)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or with other numbers and names.

    Rows of one doc_id are judged each by its text; null and empty texts hold nothing and stay. Without items all stay.
    """
    bound_batches(spark)
    found = decontam.leaks(keyed(docs), table(spark, sf_dir, "benchmark", "item_id", "text"))
    held = stage(found.select("doc_id", "key").distinct(), "held").alias("h")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("h.key"))
    return d.join(held, same, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: one row per row, a null text as an empty one, very long texts whole."""
    bound_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(docs, ranks, public_tokenizers.PATTERN, KEEP_CHUNKS, lasting=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Trained statistics, similarity groups and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
