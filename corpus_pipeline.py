"""The corpus pipeline: five operators, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs; a table that has been read is removed. All but the last return the columns of ``documents``; texts that substring dedup
changed have their n_chars counted anew.

Defined results: a null or empty text fails the quality rules; a null doc_id counts as larger than all others; repeated rows
leave one, as near duplicates; texts of any length are read whole; columns of ``documents`` beside doc_id and text keep their values,
whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from corvane.llm.common import table
from corvane.operators.iterate import remove, shared_folder


_OWN = ("doc_id", "text")


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns by number, so that none clashes with what an operator adds."""
    return docs.select(*_OWN, *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns) if c not in _OWN))


def _whole(got: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of documents again, with new values for some."""
    return got.select(*(new.get(c, F.col(c if c in _OWN else f"__c{i}")).alias(c) for i, c in enumerate(columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _whole(quality_rules.quality(_apart(docs)).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that stand in a document with a smaller doc_id; what loses all its words goes."""
    got = substring_dedup.dedup_substrings(_apart(docs)).where("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"__c{docs.columns.index('n_chars')}"))
        new["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    return _whole(got, docs.columns, **new)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontaminate), ("packing", pack)]
#: SQL can express neither consistent sampling's classes nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a table between them in the folder that spark.checkpoint.dir names."""
    at = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := posixpath.join(at, f"{k}-{name}"))
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
