"""The corpus pipeline: quality, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. For all
of them: a null or empty text counts as an empty text and a null id, language or source as a value of its own. Rows that
agree in id and text are alike: as many of them stay as the stage's operator keeps. An empty table gives an empty
one. Further columns pass through the first four stages whatever their names. Texts of any length are taken whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import exact, mixing, near, packing, quality
from inkwell.llm._tables import read, scratch, stash
from inkwell.llm.entry import tokenizer_path
from inkwell.llm.stages import keep_marked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, with the posteriors of their sites, rejects. Without labels all have the
    same rate (one half if there are none at all) and stay."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal without white space: the longest, then the least id (null
    last). All null, empty and blank texts are one group."""
    return keep_marked(docs, exact.exact_groups(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id (null last) of each class of near duplicates. All texts without words are one
    class; a text of fewer than five words is one shingle."""
    return keep_marked(docs, near.near_classes(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says, which may be never. Texts without words are taken as often as their
    source's whole epochs say; repeated rows draw the same key and follow each other in any order."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    null or empty text is one piece, its end; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Trained weights, sketches and a tokenizer have no SQL form: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes once its documents are written
            docs = stash(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
