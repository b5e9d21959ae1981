"""Concepts and typed edges from chunks: phrases between stop words stand for noun chunks; natively, without a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.texts import PRONOUNS, causal_verbs, edge_type, is_label, sentences, strip

STOP_WORDS = sorted({*"a an the and or nor of in on at to from by with for as is are was were be been being has have had do does did will would can could may might shall should must not no so if than into over under about between through during because since therefore thus hence however but although despite yet whereas such including then before after first next finally".split(), *PRONOUNS})
# by first letters, so that most words are passed over after one
_BY_LETTER = "|".join(first + "(?:" + "|".join(w[1:] for w in STOP_WORDS if w[0] == first) + ")" for first in sorted({w[0] for w in STOP_WORDS}))
_BLANKS = " \t\n\x0b\f\r\u00a0"  # what strip takes off
_CUTS = r"(?iU)(?<![\w'])(?:" + _BY_LETTER + r")(?![\w'])|[^\w\s'\-]+"


def phrases(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_no, position, sentence_no, sentence, edge_type, phrase_no, label, following, is_entity) of chunks; labels in lower case; those too short and pronouns keep their place but have a null label.

    edge_type: of the sentence, null where it has a single phrase; following: the label of the sentence's next phrase, null at its end.
    """
    # outer: below an inner generator the optimiser would filter by the arrays' sizes and so make them twice
    cut = chunks.select("doc_id", "section_no", "position", F.posexplode_outer(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    cut = cut.withColumn("phrases", F.filter(F.transform(F.split("sentence", _CUTS), lambda p: F.btrim(p, F.lit(_BLANKS))), lambda p: p != ""))
    cut = cut.withColumn("labels", F.transform(F.transform("phrases", F.lower), lambda p: F.when(is_label(p), p)))
    cut = cut.withColumn("lowered", F.lower("sentence"))  # once, not for each cue
    # an edge type for each sentence, before its phrases become rows
    cut = cut.withColumn("edge_type", F.when(F.size("phrases") > 1, edge_type(F.col("lowered"), causal_verbs(F.col("lowered"), True), True)))
    following = F.concat(F.slice("labels", 2, F.greatest(F.size("labels"), F.lit(1))), F.array(F.lit(None).cast("string")))
    cut = cut.withColumn("p", F.arrays_zip(F.col("phrases").alias("phrase"), F.col("labels").alias("label"), following.alias("following")))
    rows = cut.select("doc_id", "section_no", "position", "sentence_no", "sentence", "edge_type", F.posexplode_outer("p").alias("phrase_no", "p"))
    entity = F.col("p.phrase").rlike(r"^\p{Lu}") & ~F.startswith(F.col("sentence"), F.col("p.phrase"))
    rows = rows.where("p.phrase IS NOT NULL")
    return rows.select("doc_id", "section_no", "position", "sentence_no", "sentence", "edge_type", "phrase_no", "p.label", "p.following", entity.alias("is_entity"))


def node_id(doc_id, label):
    """A stable id of a label in a document."""
    return F.substring(F.sha2(F.concat_ws("|", doc_id, label), 256), 1, 32)


def concept_nodes(found: DataFrame) -> DataFrame:
    """(doc_id, section_no, position, node_id, label, node_type, activation, at): each chunk's distinct labels."""
    rows = found.where("label IS NOT NULL").groupBy("doc_id", "section_no", "position", "label").agg(F.bool_or("is_entity").alias("e"), F.min(F.struct("sentence_no", "phrase_no")).alias("at"))
    return rows.select("doc_id", "section_no", "position", node_id(F.col("doc_id"), F.col("label")).alias("node_id"), "label", F.when(F.col("e"), "entity").otherwise("concept").alias("node_type"), F.when(F.col("e"), 0.75).otherwise(0.70).alias("activation"), "at")


def concept_edges(found: DataFrame) -> DataFrame:
    """(doc_id, section_no, position, sentence_no, phrase_no, src, dst, edge_type) of phrases: neighbouring phrases of a sentence; one without a label breaks the chain."""
    rows = found.where("label IS NOT NULL AND following IS NOT NULL AND label != following")
    return rows.select("doc_id", "section_no", "position", "sentence_no", "phrase_no", node_id(F.col("doc_id"), F.col("label")).alias("src"), node_id(F.col("doc_id"), F.col("following")).alias("dst"), "edge_type")


def metadata_nodes(documents: DataFrame, doc_id: str = "path") -> DataFrame:
    """(doc_id, node_id, label, role, node_type, activation, protected, at): title, author and distinct headings of documents(title, author, sections)."""
    i = F.col(doc_id).cast("string")
    heads = F.transform(F.coalesce("sections", F.array().cast("array<struct<heading: string, body: string, level: int, page: int>>")), lambda s: F.struct(F.lit("heading").alias("role"), s["heading"].alias("label")))
    parts = F.concat(F.array(F.struct(F.lit("title").alias("role"), F.col("title").alias("label")), F.struct(F.lit("author").alias("role"), F.col("author").alias("label"))), heads)
    rows = documents.select(i.alias("doc_id"), F.posexplode(parts).alias("at", "p")).select("doc_id", "at", "p.role", F.lower(strip(F.col("p.label"))).alias("label")).where("label != ''")
    once = rows.groupBy("doc_id", "role", "label").agg(F.min("at").alias("at"))
    return once.select("doc_id", node_id(F.col("doc_id"), F.col("label")).alias("node_id"), "label", "role", F.lit("metadata").alias("node_type"), F.lit(0.9).alias("activation"), F.lit(True).alias("protected"), "at")


def heading_edges(nodes: DataFrame, headings: DataFrame, weight: float | None = None) -> DataFrame:
    """(doc_id, src, dst, edge_type, base_weight): nodes(doc_id, node_id, heading) tied to their section's heading node; none to itself. Without a weight the edge type's counts."""
    keys = headings.where("role = 'heading'").select("doc_id", F.col("label").alias("_h"), F.col("node_id").alias("dst"))
    rows = nodes.withColumn("_h", F.lower(strip(F.col("heading")))).join(keys, ["doc_id", "_h"]).where("node_id != dst")
    return rows.select("doc_id", F.col("node_id").alias("src"), "dst", F.lit("constitutive").alias("edge_type"), F.lit(weight).cast("double").alias("base_weight")).distinct()
