"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import oracles
from graphloom.llm.language_id import language_id
from graphloom.llm.media import media_column, media_features
from graphloom.llm.mixing import mix_plan
from graphloom.llm.near_duplicates import near_duplicates
from graphloom.llm.packing import pack_documents
from graphloom.llm.token_counts import token_counts
from graphloom.llm.toxicity import toxicity
from graphloom.llm.url_filters import filter_urls, url_host
from graphloom.llm.vectors import search
from graphloom.llm.warc import archive_pages
from graphloom.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(table(spark, sf_dir, "documents")))


def op5_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are 0 and 1; grade 2 is made of the toxic rows that a first fit finds worst, so its threshold says what the model itself ranks, not what a label says."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", "grade")
    return toxicity(table(spark, sf_dir, "documents"), labels)


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def list_history(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of pages, for want of one among the tables: changes for every host and its parent domain.

    By the code points of a host's first letters: some are blocked and removed later, some blocked, then allowed.
    """
    hosts = pages.select(url_host(F.col("url")).alias("host")).where("host != ''").distinct()
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + 86400 * n)
    kind = (F.length("host") + F.ascii(F.substring("host", 3, 1))) % 4
    start = (F.ascii(F.substring("host", 2, 1)) * 7 + F.length("host")) % 200
    rows = hosts.select("host", kind.alias("k"), start.cast("long").alias("start"))
    change = lambda kind, pattern, action, n: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("changed_at"))
    host, parent = F.col("host"), F.regexp_replace("host", r"^[^.]+\.", "")
    made = F.when(F.col("k") == 0, F.array(change("host", host, "block", F.col("start")), change("host", host, "remove", F.col("start") + 60)))
    made = made.when(F.col("k") == 1, F.array(change("host", host, "block", F.col("start")), change("host", host, "allow", F.col("start") + 45), change("host", host, "block", F.col("start") + 120)))
    made = made.when(F.col("k") == 2, F.array(change("domain", parent, "block", F.lit(100))))
    made = made.otherwise(F.array(change("prefix", F.concat(host, F.lit("/en")), "block", F.col("start") + 10)))
    return rows.select(F.explode(made).alias("c")).select("c.*").distinct()


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 104_729 % 31_536_000)  # the tables have no fetch times
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_at"))
    return filter_urls(captures, list_history(pages)).withColumnRenamed("capture_id", "page_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are indexed, but for those that are null, zero, not finite throughout or (all have 64 numbers here) of another length than most."""
    return search(table(spark, sf_dir, "embeddings"), query_every=20, k=20)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_best_two_fit_packing": op5_best_two_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_pareto_mixing": op8_pareto_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLES = {
    "op3_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op7_warc_salvage": oracles.WARC,
    "op8_pareto_mixing": oracles.MIXING,
    "op9_url_filters": oracles.URL_FILTERS,
}
