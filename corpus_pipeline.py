"""A corpus pipeline: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  Every stage carries
columns beyond those of documents, whatever their names (packing returns its own
instead), and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm.common import materialize
from rankwell.llm.mixing import mixed_documents
from rankwell.llm.neardup import without_near_duplicates
from rankwell.llm.packing import pack
from rankwell.llm.quality import good_documents
from rankwell.llm.queries import table, tokenizer_path
from rankwell.llm.substring import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Every row is judged by its own text, repeated rows and null ids too; a null or empty text
    is judged as an empty one.  Without labelled rows all scores are 0.5, so none stays.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The smallest id of a group stays; of rows that share an id, one stays; rows with a null id
    all stay, as do null and empty texts, which are linked with nothing.
    """
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows.

    Every row stays, with what is left of its text; a row that occurs twice loses its windows
    in both places.  Null, empty and short texts stay as they are.
    """
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or parts of them, as often as the mix takes them.

    Rows without words (null or empty texts) are not in the mix; null is a source of its own;
    repeated rows and null ids take part like others.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences.

    A null or empty text is the end token alone; null ids are kept, repeated rows are packed
    as often as they occur, texts of any length are cut.
    """
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Several stages (a trained model, MinHash, pseudorandom permutations, a tokenizer) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
