"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import helper, table
from kindred.llm.language import UNDETERMINED, learn, learnable, with_language
from kindred.llm.lines import COUNTS, dedup_lines
from kindred.llm.mixing import in_order
from kindred.llm.near_copies import keep_one
from kindred.llm.packing import pack_in_order
from kindred.sources.scratch import materialize, small_batches

#: A document whose likeliest language is less probable than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language (learned from the labelled ones); others go."""
    small_batches(spark)
    pred, score = (f"{helper(docs.columns)}{x}" for x in ("lang", "score"))
    judged = with_language(docs, learn(learnable(docs)), docs.columns, (pred, score))
    return judged.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which no word is left. n_chars follows the text."""
    small_batches(spark)
    names = tuple(f"{helper(docs.columns)}{x}" for x in COUNTS)
    deleted = F.col(names[1])
    done = dedup_lines(docs, names=names).where((deleted == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(deleted > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: SimHash links, then all similarities of 0.8 or more that they leave apart."""
    small_batches(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their position in the mix."""
    small_batches(spark)
    return in_order(docs, position=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in sequences, which follow the mix."""
    small_batches(spark)
    return pack_in_order(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: The stages can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
