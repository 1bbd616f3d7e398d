"""A corpus pipeline: language ID, near-dedup, secret scans, mixing, and encoding.

Every stage takes all documents that the one before kept and returns them, but for the last, with
the columns of documents, whatever their names. Null ids, repeated rows and null or empty texts
are let through or dropped as each stage says; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import bpe, langid, minhash, mixing, secrets
from readlake.llm.common import delete, new_path, scope

#: A document is rejected if its words' highest chances are less than this on the average: 1.2 times
#: an even chance among three languages, and as many times among more.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: letters, and words that the model is not lost about, of
    one language or several. Null and empty texts and those without a letter go; repeated rows and
    null ids stay; a mean of just the least score stays. A long text is judged whole."""
    return langid.keep_identified(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the
    smallest id, or one of those without id if none has one. Of rows that share id and text one
    stays; texts without words are no copies of each other unless their id is the same."""
    return minhash.keep_one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts are masked in the texts, and n_chars follows; every row stays,
    and those without a secret, with a null or an empty text stay as they are."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of the sources takes it. Those without words are never
    taken; rows are told apart by id and text, so null ids are documents of their own."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that the mix took, a row for each time: doc_id, n_tokens, ids_sha256,
    decoded_sha256. A null or empty text would have none."""
    return bpe.encode_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", redact), ("mixing", mix), ("encoding", encode)]

#: The stages learn a model, compare sketches and round at random, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next. What a stage has saved
    for itself goes when it is written, and what it read of an earlier one too."""
    folder = new_path(spark)

    def step(docs: DataFrame, stage: tuple[int, tuple]) -> DataFrame:
        number, (name, function) = stage
        with scope(spark):
            function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if number:
            delete(spark, f"{folder}/{STAGES[number - 1][0]}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, enumerate(STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))
