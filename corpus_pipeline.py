"""A training corpus from ``documents``: quality, toxicity, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return documents' own columns. Each works on all rows that the stage
before kept. Models learn from the labelled rows of the folder's ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm import decontaminate, packing, quality_model, simhash, toxicity
from kithline.llm.common import drop_path, fresh_path, scratch, table, written
from kithline.llm.queries import tokenizer_path

#: A document that the classifier rejects (op7's predicted = 0) goes.
LEAST_QUALITY = quality_model.KEEP


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the classifier keeps. A null or empty text gets the learned prior; equal texts fare alike; an empty table gives no rows."""
    model = quality_model.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, model).filter(F.col("out.score") >= LEAST_QUALITY).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that aren't toxic. A null or empty text has no words and stays; equal texts fare alike; an empty table gives no rows."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter(F.col("out.p_toxic") < toxicity.TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs of each group of near-duplicates; null and empty texts are one group, repeated rows too; an empty table gives no rows."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that aren't contaminated. A null or empty text never is; equal texts fare alike; an empty table gives no rows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of docs' token ids, with the documents and places of their pieces. A null or empty text is its end id; an empty table gives no rows."""
    return packing.pack_documents(docs, tokenizer_path(), added=True)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Trained models and packing have no SQL form; tests hold the stages against their operators, and those against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next; a stage's result goes once that of the next is written, and what it wrote besides goes with it."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"stage{k}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "", path)
        if last:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
