"""The corpus pipeline: language, toxicity, near-duplicates, mixture, packing. Counts as part of subpackage llm.

Each stage works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.language_id import fit_language_model, held_out, identify
from graphloom.llm.mixing import mix_sources
from graphloom.llm.near_duplicates import near_duplicates
from graphloom.llm.packing import pack_documents
from graphloom.scratch import Scratch
from graphloom.llm.toxicity import fit_severity, severity
from graphloom.session import table, workers_find_package

#: A prediction less likely than this is no known language.
LEAST_LANGUAGE = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """The name, made longer until it is no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, and those like no language, go."""
    model = fit_language_model(docs.where(~held_out()))
    name = _free(docs, "_language")
    told = identify(docs, model, column=name)
    return told.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_LANGUAGE)).drop(name)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is more likely grade 0 than any higher one."""
    model = fit_severity(docs, table(spark, sf_dir, "labels").withColumnRenamed("toxic", "grade"))
    name = _free(docs, "_severity")
    return severity(docs, model, name).where(~F.col(f"{name}.toxic")).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, similarity 0.8 or more), that of the smallest id.

    Of rows that repeat an id and its text one stays; different texts of one id stay, as far as their id does. Rows without id belong to no group and stay.
    """
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id").distinct()
    name = _free(docs, "_text")
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").withColumn(name, F.sha2(F.col("text"), 256))
    return named.dropDuplicates(["doc_id", name]).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a document that the mixture took twice is packed twice."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=0)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("near-duplicates", keep_one_of_each),
    ("mixture", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    workers_find_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(before)
    scratch.keep(docs)
    return docs


#: Models are fitted and texts tokenized: no SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
