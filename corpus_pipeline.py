"""A corpus pipeline out of five of the operators in ``arrears.llm``.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a table that is written and read again as the next one's docs.
All but the last return the columns of ``documents``. Null ids and texts pass
every stage by the operators' own rules; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import line_dedup, mixing, near_dups, toxicity, unigram
from arrears.llm.common import bounded_batches, fresh, table
from arrears.session import pin


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring as toxic go; the model learns from their labels."""
    bounded_batches(spark)
    odds = fresh("score")
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out=odds).where(F.col(odds) < toxicity.THRESHOLD).select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal lines stay once. No document goes, but texts get shorter."""
    bounded_batches(spark)
    cut = line_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def documents_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays; rows
    go one by one, whatever their ids."""
    bounded_batches(spark)
    rid = fresh("rid")
    rows = line_dedup.numbered(docs, rid)
    gone = near_dups.near_duplicates(rows, row_id=rid).where("not stays").select(rid)
    return rows.join(gone, rid, "left_anti").select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as piece ids; copies are encoded as often as they occur."""
    bounded_batches(spark)
    return unigram.encode(docs.select("doc_id", "text")).select("doc_id", "ids")


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("near_dedup", documents_once),
    ("mixing", to_weights),
    ("sentencepiece", encoded),
]

#: stages train a model and verify links on word sets: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
