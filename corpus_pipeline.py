"""The training-data pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; all but the last return
the columns of ``documents``. ``run`` applies them to ``documents``; between stages the rows are written
to the shared scratch folder and read again. The mixing stage's order goes from it to packing as the order
of the files' numbers and of the rows in each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import jaccard, mil, packing, pfair, surrogates
from tidefold.llm.common import Scratch, table
from tidefold.llm.tokens import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: documents that the classifier rejects go."""
    model = mil.train(docs, table(spark, sf_dir, "labels"))
    return mil.score(docs.select(*COLUMNS), model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: of each group of near duplicates the first document stays (by doc_id, then text)."""
    return jaccard.kept(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: texts get surrogates; n_chars follows the text."""
    out = surrogates.replace(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: all documents, in the order of the schedule: files and rows follow each other in it."""
    mixed = pfair.mix_sources(docs.select(*COLUMNS))
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: pieces with their sequences and offsets; sequence_id follows the mix order, which the files hold."""
    file = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    placed = docs.withColumn("position", F.shiftleft(file, 36) + F.col("_metadata.row_index"))
    return packing.pack_documents(placed, vocabulary_path(), order="position")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", pack)]

#: The classifier and the search for surrogates can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
