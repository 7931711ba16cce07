"""A corpus pipeline of five stages over `documents`, each written and read back before the next.

Documents judged toxic go, one document of each group of near duplicates stays, documents that hold
benchmark items go, personal data gets pseudonyms, and what remains is encoded. All stages but the last
return the columns of `documents`; the last returns the digests of the token ids and of the decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, contamination, near_dups, pii, toxicity
from plumbline.llm.common import durable, small_batches, table
from plumbline.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dups.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms can be longer or shorter (an IP address), so n_chars is counted anew."""
    small_batches(spark)
    changed = pii.pseudonymise(docs, found=None)
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_digests(docs, RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs)
    return docs


#: Several stages have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None
