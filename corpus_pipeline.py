"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``repertoire.llm``.

quality -> exact dedup -> near dedup -> decontamination -> packing. Each stage works on all rows that
the one before kept; all but the last keep the columns of ``documents``. The quality stage learns from
``labels``, decontamination reads ``benchmark``; near-duplicates are five-word shingle sets with a
similarity of 0.8 or more, of which the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repertoire.llm._shared import written
from repertoire.llm.decontam import decontaminate
from repertoire.llm.exact_dedup import exact_dedup
from repertoire.llm.near_dedup import near_dedup
from repertoire.llm.packing import packed
from repertoire.llm.quality import quality_filter


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field of ``labels`` does not reject (score below the operator's threshold).

    Null and empty texts are one empty line and get the score of one; ids that come more than once share the fate of
    their worst row; rows without an id stay, as no table can name them; without labels of both kinds nothing
    goes; an empty table gives no rows. Columns as given, whatever their names.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest original, then the smallest id.

    Null counts as the empty text, and all empty texts are one group; rows that repeat the id kept all stay; rows
    without an id stay; an empty table gives no rows. Columns as given.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each connected group of five-word shingle sets at 0.8 similarity or more.

    Texts without words are in no group; shorter ones than a shingle are one shingle; rows that repeat an id are one
    node; rows without an id stay; an empty table gives no rows. Columns as given.
    """
    return near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of ``benchmark`` (shorter items are one window).

    Null texts have no words and stay; benchmark rows without text match nothing, those without an id count; rows
    without an id stay; an empty table, or benchmark, takes nothing out. Columns as given.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 ids that hold the sources' shares (see ``packed`` for its columns).

    A null text gives its end id alone, a null source is the source ''; repeated rows and rows without an id are packed
    like others; an empty table gives no rows.
    """
    return packed(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier, MinHash groups and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
