"""A cleaning pipeline over ``documents``: toxic texts go, unidentified languages go, one document of each
group of near copies stays, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from circuitscope.llm import langid, near_copies, packing, pfor, toxicity
from circuitscope.llm.common import drop_scratch, materialize, read_table, write_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the toxicity operator, trained on the labelled ones among them, doesn't predict to be toxic.

    Null and empty texts have no evidence and stay; without labels of both kinds every document stays.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents most of whose words have one learned language. Null texts and texts without a letter go."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles of a similarity of 0.8 or more: that of the smallest id.

    All texts without a word are copies of each other; rows of null id stay; rows that repeat an id stay or go together.
    """
    return near_copies.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every remaining document in sequences of the permitted lengths, counted in the vocabulary's tokens and an end mark.

    Longer documents are cut into pieces, a row each; repeated rows have a place each.
    """
    return packing.pack(materialize(pfor.token_counts(docs), "lengths"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn models and search by similarity, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next, then dropped.

    The stages pass columns on as they are, those beyond the documents' own included. An empty table gives an empty one.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = write_scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
