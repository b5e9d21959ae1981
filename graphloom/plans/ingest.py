"""From documents to graph rows: whole batches of documents in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import Config
from graphloom.functions.embedding import Embedder, embed_labels
from graphloom.functions.texts import base_name, first_words, section_text, strip
from graphloom.operators.chunking import chunk_documents, long_enough
from graphloom.operators.extraction import concept_edges, concept_nodes, heading_edges, metadata_nodes, phrases
from graphloom.operators.graph import type_weight
from graphloom.operators.similarity import window_edges
from graphloom.sources.documents import sections_of


def document_rows(documents: DataFrame, embedder: Embedder, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) of documents (schemas.DOCUMENTS): metadata nodes, chunks' concepts, their edges and those to the headings.

    nodes and edges are as in schemas, before merging, with a doc_id; `ord` follows document, section, chunk and place. The report has a
    row for each document: path, success, format, chunks, nodes, edges, error.
    """
    good = documents.where("error IS NULL")
    texts = sections_of(good).select(F.col("path").alias("doc_id"), "section_no", "heading", section_text(F.col("heading"), F.col("body")).alias("text"))
    chunks = long_enough(chunk_documents(texts, config))
    found = phrases(chunks)
    concepts, edges = concept_nodes(found), concept_edges(found)
    meta = metadata_nodes(good)
    heads = texts.select("doc_id", "section_no", "heading").where(F.coalesce("heading", F.lit("")) != "")
    tied = heading_edges(concepts.join(heads, ["doc_id", "section_no"]), meta)
    order = Window.partitionBy("doc_id").orderBy("_first", "section_no", "position", "at")
    columns = ["doc_id", "node_id", "label", "node_type", "activation"]
    nodes = meta.select(*columns, "protected", F.lit(0).alias("_first"), F.lit(0).alias("section_no"), F.lit(0).alias("position"), F.struct(F.col("at").alias("sentence_no"), F.lit(0).alias("phrase_no")).alias("at"))
    nodes = nodes.unionByName(concepts.select(*columns, F.lit(False).alias("protected"), F.lit(1).alias("_first"), "section_no", "position", "at"))
    nodes = nodes.select(*columns, "protected", F.lit(None).cast("array<double>").alias("embedding"), F.lit(1.0).alias("agreement"), F.lit(1.0).alias("recency"), F.row_number().over(order).cast("long").alias("ord"))
    by_place = Window.partitionBy("doc_id").orderBy("_first", "section_no", "position", "sentence_no", "phrase_no", "src", "dst")
    rows = edges.select("doc_id", "src", "dst", "edge_type", type_weight(F.col("edge_type")).alias("base_weight"), F.lit(0).alias("_first"), "section_no", "position", "sentence_no", "phrase_no")
    rows = rows.unionByName(tied.select("doc_id", "src", "dst", "edge_type", type_weight(F.col("edge_type")).alias("base_weight"), F.lit(1).alias("_first"), *(F.lit(0).alias(c) for c in ("section_no", "position", "sentence_no", "phrase_no"))))
    rows = rows.select("doc_id", "src", "dst", "edge_type", "base_weight", F.lit(1.0).alias("agreement"), F.row_number().over(by_place).cast("long").alias("ord"))
    count = lambda frame, name: frame.groupBy(F.col("doc_id").alias("path")).agg(F.count(F.lit(1)).alias(name))
    report = documents.select("path", "format", "error")
    for frame, name in ((chunks, "chunks"), (nodes, "nodes_added"), (rows, "edges_added")):
        report = report.join(count(frame, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    error = F.coalesce("error", F.when(F.col("chunks") == 0, "no chunk is long enough"))
    report = report.withColumn("error", error).withColumn("success", F.col("error").isNull())
    return embed_labels(nodes, embedder), rows, report


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("success").alias("files_ok"), F.count_if(~F.col("success")).alias("files_failed"), F.sum("nodes_added").alias("total_nodes"), F.sum("edges_added").alias("total_edges"))


def report_lines(report: DataFrame) -> DataFrame:
    """(path, line): a line of text for each document."""
    good = F.format_string("  OK  %s  [%s]  %d chunks  %d nodes  %d edges", base_name(F.col("path")), "format", "chunks", "nodes_added", "edges_added")
    return report.select("path", F.when(F.col("success"), good).otherwise(F.format_string("  FAILED  %s: %s", "path", "error")).alias("line"))


def simple_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, i, n, label, sentence): texts cut at full stops; pieces of more than ten characters; the first six words are the label."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(text, "\n", " "), r"\.")).alias("at", "s")).select("doc_id", "at", strip(F.col("s")).alias("sentence")).where(F.length("sentence") > 10)
    order = Window.partitionBy("doc_id").orderBy("at")
    return cut.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"), first_words(F.col("sentence")).alias("label"), "sentence")


def simple_rows(sentences: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sentences: one node each, a sequential edge to the next one, and semantic edges two to five places on between similar vectors(doc_id, i, v)."""
    i = F.concat_ws(":", "doc_id", "i")
    recency = 1.0 - (F.col("i") / F.col("n")) * 0.2
    nodes = sentences.select("doc_id", i.alias("node_id"), "label", F.lit(None).cast("array<double>").alias("embedding"), F.lit(0.7).alias("activation"), F.lit(False).alias("protected"), F.lit("concept").alias("node_type"), F.lit(1.0).alias("agreement"), recency.alias("recency"), F.col("i").alias("ord"))
    following = F.concat_ws(":", "doc_id", F.col("i") + 1)
    chain = sentences.where("i + 1 < n").select("doc_id", i.alias("src"), following.alias("dst"), F.lit("sequential").alias("edge_type"), F.lit(0.70).alias("base_weight"), F.lit(1.0).alias("agreement"), (F.col("i") * 8).alias("ord"))
    if vectors is None:
        return nodes, chain
    named = vectors.select(F.col("doc_id").alias("doc"), F.col("i").alias("pos"), F.concat_ws(":", "doc_id", "i").alias("id"), "v")
    near = window_edges(named, threshold).join(named.select(F.col("id").alias("src"), "pos"), "src")
    semantic = near.select(F.col("doc").alias("doc_id"), "src", "dst", F.lit("semantic").alias("edge_type"), (F.col("similarity") * 0.55).alias("base_weight"), F.col("similarity").alias("agreement"), (F.col("pos") * 8 + F.col("apart")).alias("ord"))
    return nodes.withColumn("embedding", F.lit(None).cast("array<double>")), chain.unionByName(semantic)
