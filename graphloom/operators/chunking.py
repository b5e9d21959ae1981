"""Text segmentation: headings, paragraphs, chunks of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import Config
from graphloom.functions.texts import HEADING_CAPITALS, HEADING_MARKDOWN, HEADING_NUMBERED, SENTENCE_END, heading, heading_as_written, strip
from graphloom.schemas import CHUNKS

_HEADINGS = [(re.compile(HEADING_MARKDOWN), 2), (re.compile(HEADING_NUMBERED), 2), (re.compile(HEADING_CAPITALS), 1)]
_SENTENCE_END = re.compile(SENTENCE_END)
_BLANK_LINES = re.compile(r"\n{2,}")


def sectionise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_written: bool = False) -> DataFrame:
    """(doc_id, section_no, heading, char_start, body): texts cut at their heading lines, natively.

    A heading line numbers the lines up to the next one by a running sum; sections with an empty body fall away. char_start: the
    offset of the heading line (for text before any heading, 0). as_written: heading lines keep their numbers and are not stripped.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("h", heading_as_written(F.col("line")) if as_written else heading(F.regexp_replace("line", r"\s+$", "")))
    running = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("section_no", F.sum(F.col("h").isNotNull().cast("int")).over(running)).withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("doc_id", "section_no").agg(F.coalesce(F.max("h"), F.lit("")).alias("heading"), F.min("at").cast("long").alias("char_start"), strip(body).alias("body"))
    return out.where("body != ''").select("doc_id", F.col("section_no").cast("int").alias("section_no"), "heading", "char_start", "body")


def quality(chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, poor): whether one chunk holds over four fifths of a text, or chunks are too long on average."""
    n = F.length("text")
    sums = chunks.groupBy("doc_id").agg(F.max(n).alias("m"), F.sum(n).alias("s"), F.avg(n).alias("a"))
    return sums.select("doc_id", ((F.col("s") == 0) | (F.col("m") / F.col("s") > 0.8) | (F.col("a") > config.max_chars)).alias("poor"))


def _heading(line: str) -> str | None:
    for pattern, group in _HEADINGS:
        if m := pattern.match(line):
            return m[group].strip()
    return None


def _by_heading(text: str) -> list[tuple[str, int, str]]:
    """(heading, offset, text) of the parts between heading lines that are not blank."""
    parts, title, began, held, at = [], "", 0, [], 0
    for line in text.splitlines(keepends=True):
        found = _heading(line.rstrip())
        if found is not None:
            parts.append((title, began, "".join(held)))
            title, began, held = found, at, []
        else:
            held.append(line)
        at += len(line)
    parts.append((title, began, "".join(held)))
    return [(h, a, t.strip()) for h, a, t in parts if t.strip()]


def _by_paragraph(text: str, target: int) -> list[tuple[str, int, str]]:
    out, held, size, began, at = [], [], 0, 0, 0
    ends = [m.span() for m in _BLANK_LINES.finditer(text)] + [(len(text), len(text))]
    for stop, following in ends:
        paragraph = text[at:stop].strip()
        if paragraph:
            if not held:
                began = at
            held.append(paragraph)
            size += len(paragraph)
            if size >= target:
                out.append(("", began, "\n\n".join(held)))
                held, size = [], 0
        at = following
    if held:
        out.append(("", began, "\n\n".join(held)))
    return out


def _cut_long(title: str, began: int, text: str, most: int) -> list[tuple[str, int, str]]:
    """Pieces of at most `most` characters: up to the last sentence end in the window, else the last space, else hard."""
    out, at = [], 0
    while len(text) - at > most:
        window = text[at : at + most]
        ends = [m.start() + 1 for m in _SENTENCE_END.finditer(window)]
        cut = ends[-1] if ends else window.rfind(" ")
        cut = cut if cut > 0 else most
        out.append((title, began + at, window[:cut].strip()))
        at += cut
    out.append((title, began + at, text[at:].strip()))
    return [x for x in out if x[2]]


def chunk_text(text: str | None, config: Config = Config()) -> list[dict]:
    """The chunks of one text, numbered from 0: by headings; without any, and if that leaves poor chunks, by paragraphs; none longer than the ceiling."""
    if not text or not text.strip():
        return []
    parts = _by_heading(text)
    if not any(h for h, _, _ in parts):
        sizes = [len(t) for _, _, t in parts]
        if not sizes or max(sizes) / sum(sizes) > 0.8 or sum(sizes) / len(sizes) > config.max_chars:
            parts = _by_paragraph(text, config.target_chars)
    cut = [piece for h, a, t in parts for piece in (_cut_long(h, a, t, config.max_chars) if len(t) > config.max_chars else [(h, a, t)])]
    return [{"position": i, "heading": h, "text": t, "char_start": a} for i, (h, a, t) in enumerate(cut)]


def chunk_documents(docs: DataFrame, config: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks (schemas.CHUNKS) of docs; the cuts depend on each other, so a text is cut as a whole, by an Arrow-batched function."""

    @F.pandas_udf("array<struct<position: int, heading: string, text: string, char_start: long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([chunk_text(t, config) for t in texts])

    section = F.col("section_no") if "section_no" in docs.columns else F.lit(0)
    out = docs.select(F.col(doc_id).cast("string").alias("doc_id"), section.cast("int").alias("section_no"), F.explode(cut(F.col(text))).alias("c")).select("doc_id", "section_no", "c.*")
    return out.select(*(x.split()[0] for x in CHUNKS.split(", ")))


def long_enough(chunks: DataFrame, config: Config = Config()) -> DataFrame:
    return chunks.where(F.length(strip(F.col("text"))) >= config.min_chars)
