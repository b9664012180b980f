"""From raw documents to token ids: five stages, each over all that the one before kept.

1. ``language_id``: documents whose language the model rejects (among them those without a
   letter) go.
2. ``near_dedup``: texts link if four in five of their five-word shingles are common and the SimHash
   fingerprints of their distinct words differ in seven bits at most.  Of each component one row stays, that with
   the smallest id, then the smallest hash of its columns.  A row with a null id stays only if
   its component has no id at all; an id that names rows of several components can stay in each.
3. ``pii``: personal data gives way to ``<KIND>`` marks.
4. ``mix``: documents are dropped or repeated so that each source comes near its target.
5. ``bpe``: the result, a row for each kept copy: doc_id, n_tokens, ids and digests.

All but the last return the columns of ``documents``.  Null and empty texts go with the first stage, as they have no
letter; very long ones are worked through whole, in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, langid, mixing, pii, simhash
from twinsift.llm.common import checkpoint_folder
from twinsift.llm.queries import RANKS

#: Stages that SQL can't express are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, langid.usable_rows())
    return langid.predict(docs, model, "doc_id", "text", *docs.columns).where(~F.col("rejected")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, RANKS, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mix", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them lies a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
