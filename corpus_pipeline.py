"""The training-data pipeline: stages that each take what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all, if the labels are too few for a model.

    Each row is judged by its whole text: a null one as an empty one, repeated ones alike. No row gives no row.
    """
    return quality.accepted(docs, quality.train(docs, common.read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id, a null id only if there is no other; one of repeated rows."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that SimHash links the one with the smallest doc_id, a null id only if there is no other; one of repeated rows.

    Texts without words, null ones among them, link with each other. Rows with null or equal ids whose texts do not
    link all stay.
    """
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, in training order.

    Each row has copies of its own, whatever its id. A null source is a source of its own; a source without words
    takes none of its documents, and a document without words, null ones too, is taken like its neighbours.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all copies with their places in sequences of 1,024 tokens; a null text has the end token alone."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the components and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each is written to the shared folder and read again as the next one's input.

    Columns of documents beside doc_id, text and source are carried along until the packing, whatever their names. An
    empty table gives an empty result.
    """
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
