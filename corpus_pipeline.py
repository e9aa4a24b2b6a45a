"""From documents to packed sequences: five stages, each written as Parquet and read again by the next.

All but the last return the columns of their input, in order, whatever further columns there are (path, if there is
one, is read by the secret scan).  An empty table stays empty through all stages.  The other cases are stated at
each stage; a null text counts as an empty one everywhere and stays null.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import mixing, packing, quality, secrets, simhash
from kgspark.llm.common import chunks, documents, stage, texts_of
from kgspark.sources.staging import drop_staged, staged_paths


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 or more).

    Null, empty and blank texts all have the score of the model's bias, so they stay where most labels are 1, as they
    do if there are no labels (0.5).  Null doc_id: scored like any other.  Repeated rows: all stay or all go.  Very
    long texts are scored whole."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array(sent.value.score(texts_of(part)) >= quality.THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, ties by the hash of the text.

    Texts without words are copies of each other.  A null doc_id comes after all numbers.  Of repeated rows one stays;
    rows of one doc_id with different texts are different documents."""
    return simhash.deduplicate(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets struck out and n_chars counted anew where that happened.

    Null and empty texts have none; repeated rows are changed alike; null sources count as an empty path."""
    return secrets.redact(docs, secrets.train(words=secrets.learn_words(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (not at all, or up to three times).

    Documents without words have size 0 and are taken as often as their source's share says, rounded down.  A null source is
    a source of its own, last in order.  Equal rows of one doc_id share their copies."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens.

    Null and empty texts are the piece [0]; every repeat of a row has a place of its own; texts over 2,048 tokens are cut."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Embeddings, fingerprints and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    others = set(staged_paths(spark))
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        # what this stage read, and its operators' own tables, are not needed any more
        *done, _ = [path for path in staged_paths(spark) if path not in others]
        drop_staged(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)


