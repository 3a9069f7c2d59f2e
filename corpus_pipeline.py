"""A corpus pipeline of five stages: toxic documents go, one document of each group of near copies stays, personal data is
replaced, sources are mixed to their weights, and what is left is packed into token windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows of
a stage are written and read again before the next one begins.

Defined results of all stages: null and empty texts are documents like others (they are not toxic, link with nothing, hold no
personal data, have size 0 in the mix and are packed as the end token alone); null ids, languages and sources stay null, and
a null source is a source of its own; rows that are repeated stay or go together in the first two stages and are documents of
their own in the others; very long texts are treated whole; an empty table gives an empty table; ties do not matter but in the
mix, where rows that share a key are taken together. Columns of other names than those of documents are carried along up to
the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, ngram_join, packing, pii, toxicity
from weftline.llm.common import saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from the labels of those that may be learned from."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group that links by five-word shingles at 0.75."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans replaced; ``n_chars`` follows the new text."""
    return pii.redact_documents(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice is two rows."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Networks, components and trained trees are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what is between two stages lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
