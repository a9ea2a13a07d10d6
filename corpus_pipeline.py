"""From raw documents to packed training sequences: quality, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return rows of ``docs`` with their columns.  Between stages, rows are written to the
shared folder and read back, so a stage never repeats the work of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, jaccard, language, packing, quality
from panelspark.llm.common import load, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; texts without words go."""
    return quality.classify(docs, load(spark, sf_dir, "labels"), whole=True).where("keep").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and covers at least half of their words."""
    model = language.train(docs.where(language.remainder("doc_id", 5) != 0))
    found = language.identify(docs, model, [F.struct(*docs.columns).alias("row")], f"row {docs.schema.simpleString()}")
    return found.where("lang_pred <> 'und' and score >= 0.5").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Of rows that agree in doc_id and text one stays; rows without a doc_id can't
    stand for a group and stay.
    """
    linked = jaccard.link_components(docs)
    gone = linked.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = scratch(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    found = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), whole=True)
    return found.where(F.size("spans") == 0).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and byte-pair encoding are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
