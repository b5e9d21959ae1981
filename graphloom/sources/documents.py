"""Document sources: files of many formats into one table of structured documents. Bad files give an error, never a failure."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.texts import strip
from graphloom.schemas import DOCUMENTS

TEXT_EXTENSIONS = ("txt", "py", "js", "ts", "rst", "csv")
EXTENSIONS = (*TEXT_EXTENSIONS, "md", "html", "htm", "docx", "pdf", "ics")
# HTML elements whose text does not count, and those that never have an end tag.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([0-9A-Za-z]+;))?")
_MARKDOWN = re.compile(r"^(#{1,4})\s+(.+)")
#: Blocks are headings from this multiple of the body's font size on, of the first level from the second.
HEADING_SIZE, TOP_SIZE, LEAST_BLOCK = 1.15, 1.3, 20


def _section(heading: str, body: str, level: int = 0, page: int = 0) -> dict:
    return {"heading": heading, "body": body, "level": level, "page": page}


def _plain_text(sections: list[dict]) -> str:
    return "\n\n".join("\n\n".join(x for x in (s["heading"], s["body"]) if x) for s in sections)


class _Page(HTMLParser):
    """Collects what is seen as a flat list: ('title' | 'text', words) and ('heading', level, words)."""

    def __init__(self):
        super().__init__()
        self.seen: list[list] = []
        self.hidden: list[str] = []
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag not in VOID:
                self.hidden.append(tag)
        elif tag in SKIPPED:
            self.hidden.append(tag)
        elif tag == "title":
            self.inside = tag
        elif re.fullmatch("h[1-4]", tag):
            self.inside = tag
            self.seen.append(["heading", int(tag[1]), []])

    def handle_endtag(self, tag):
        if tag in self.hidden:  # what was left open inside ends too
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        words = data.strip()
        if not words or self.hidden:
            return
        if self.inside.startswith("h"):
            self.seen[-1][2].append(words)
        else:
            self.seen.append(["title" if self.inside == "title" else "text", 0, [words]])


def _closed_reference(m: re.Match) -> str:
    return m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:]


def parse_html(text: str, closed: bool = False) -> dict | None:
    """closed: only character references that end with a semicolon are resolved; browsers also resolve some without, as `&amp` before a tag."""
    page = _Page()
    page.feed(_REFERENCE.sub(_closed_reference, text) if closed else text)
    page.close()
    title = "".join(w for kind, _, ws in page.seen if kind == "title" for w in ws)
    runs: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for kind, level, words in page.seen:
        if kind == "heading":
            runs.append((" ".join(words), level, []))
        elif kind == "text":
            runs[-1][2].extend(words)
    sections = [_section(h, " ".join(ws), level) for h, level, ws in runs if ws]
    if not sections:
        plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()
        if not plain:
            return None
        sections = [_section("", plain)]
    return {"title": title, "format": "html", "sections": sections}


def parse_markdown(text: str) -> dict | None:
    if not text.strip():
        return None
    runs: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for line in text.splitlines():
        if m := _MARKDOWN.match(line):
            runs.append((m[2].strip(), len(m[1]), []))
        else:
            runs[-1][2].append(line)
    sections = [_section(h, body, level) for h, level, lines in runs if (body := "\n".join(lines).strip())]
    title = next((h for h, level, _ in runs if level == 1), "")
    return {"title": title, "format": "md", "sections": sections or [_section("", text.strip())]}


def parse_docx(data: bytes) -> dict | None:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {} if styles is None else {s.get(word + "styleId"): (n.get(word + "val") or "") for s in styles.iter(word + "style") if (n := s.find(word + "name")) is not None}
    prop = lambda name: next((e.text or "" for e in core.iter() if e.tag.endswith("}" + name)), "") if core is not None else ""
    runs: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for p in body.iter(word + "p"):
        text = "".join(t.text or "" for t in p.iter(word + "t")).strip()
        style = next((s.get(word + "val") or "" for s in p.iter(word + "pStyle")), "")
        m = re.match(r"heading ?(\d+)|title", names.get(style, style), re.IGNORECASE)
        if m and text:
            runs.append((text, int(m[1] or 0), []))
        elif text:
            runs[-1][2].append(text)
    sections = [_section(h, "\n".join(lines), level) for h, level, lines in runs if lines]
    if not sections:
        flat = "\n".join(h for h, _, _ in runs if h)
        if not flat:
            return None
        sections = [_section("", flat)]
    return {"title": prop("title"), "author": prop("creator"), "date": prop("created"), "format": "docx", "sections": sections}


def parse_ics(text: str) -> dict | None:
    """Each event as 'start. summary. description', of the parts there are."""
    lines = re.sub(r"\r?\n[ \t]", "", text)
    events = []
    for event in re.findall(r"BEGIN:VEVENT(.*?)END:VEVENT", lines, re.DOTALL):
        fields = dict(re.findall(r"^(DTSTART|SUMMARY|DESCRIPTION)(?:;[^:\r\n]*)?:([^\r\n]*)", event, re.MULTILINE))
        value = {k: re.sub(r"\\([,;\\])", r"\1", v.replace("\\n", "\n")).strip() for k, v in fields.items()}
        events.append(". ".join(value[k] for k in ("DTSTART", "SUMMARY", "DESCRIPTION") if value.get(k)))
    body = "\n".join(e for e in events if e)
    return {"format": "ics", "sections": [_section("", body)]} if body else None


def pdf_blocks(data: bytes) -> list[tuple[int, int, str, list[float]]]:
    """(page, block, text, font size of each character) of a PDF, where its parser is installed. Empty lines fall away, others are joined by a space."""
    from pdfminer.high_level import extract_pages
    from pdfminer.layout import LTChar, LTTextContainer

    out = []
    for page, layout in enumerate(extract_pages(io.BytesIO(data)), 1):
        for block, part in enumerate(x for x in layout if isinstance(x, LTTextContainer)):
            lines = [line for line in part if hasattr(line, "get_text") and line.get_text().strip()]
            out.append((page, block, " ".join(line.get_text().strip() for line in lines), [c.size for line in lines if hasattr(line, "__iter__") for c in line if isinstance(c, LTChar)]))
    return out


def pdf_text(data: bytes) -> str:
    """The whole text of a PDF, where its parser is installed."""
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(data)).strip()


def parse_pdf(data: bytes) -> dict | None:
    """Sections by font size: the body's is the commonest of all characters. A file without sizes or sections, or whose layout fails, is one section."""
    try:
        blocks = pdf_blocks(data)
    except ImportError:
        raise
    except Exception:  # the layout cannot be told; its text may still
        blocks = []
    by_size = Counter(s for *_, sizes in blocks for s in sizes)
    usual = by_size.most_common(1)[0][0] if by_size else 0.0
    runs: list[tuple[str, int, int, list[str]]] = [("", 0, 1, [])]
    for page, _, text, sizes in blocks if by_size else []:
        size = sum(sizes) / len(sizes) if sizes else usual
        large = size >= HEADING_SIZE * usual
        if re.fullmatch(r"\d+", text) or (len(text) < LEAST_BLOCK and not large) or not text:
            continue
        if large:
            runs.append((text, 1 if size >= TOP_SIZE * usual else 2, page, []))
        else:
            runs[-1][3].append(text)
    sections = [_section(h, "\n".join(t), level, page) for h, level, page, t in runs if t]
    if not sections and (text := pdf_text(data)):
        sections = [_section("", text)]
    return {"format": "pdf", "sections": sections} if sections else None


def parse_file(path: str, data: bytes) -> dict:
    """One file as a row of schemas.DOCUMENTS but for its path; `error` says what kept it from being read."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    text = data.decode("utf-8", "ignore") if kind not in ("docx", "pdf") else ""
    try:
        if kind in TEXT_EXTENSIONS:
            found = {"format": "txt", "sections": [_section("", text.strip())]} if text.strip() else None
        elif kind in ("html", "htm"):
            found = parse_html(text)
        elif kind == "md":
            found = parse_markdown(text)
        elif kind == "ics":
            found = parse_ics(text)
        elif kind in ("docx", "pdf"):
            found = (parse_docx if kind == "docx" else parse_pdf)(data)
        else:
            return {"error": f"unsupported extension: {kind}"}
    except Exception as e:  # a bad file is a row with an error
        return {"error": f"{type(e).__name__}: {e}"}
    if found is None:
        return {"error": "no text"}
    return {"title": "", "author": "", "date": "", "error": None, "raw_text": _plain_text(found["sections"])} | found


def parse_files(files: DataFrame) -> DataFrame:
    """schemas.DOCUMENTS of files(path, content), as the binaryFile source gives them."""
    names = re.findall(r"(?:^|, )(\w+) (?:string|array)", DOCUMENTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **parse_file(p, bytes(c))} for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def read_folder(spark: SparkSession, folder: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All supported files of a folder as documents. Raises ValueError if it is no folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise ValueError(f"not a folder: {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    return parse_files(files)


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The given files as documents, in any order; a missing file is a row with an error."""
    there, hollow, missing = _found(spark, paths)
    lost = spark.createDataFrame([(p, "no such file") for p in missing] + [(p, "no text") for p in hollow], "path string, error string")
    names = re.findall(r"(?:^|, )(\w+) (?:string|array)", DOCUMENTS)
    empty = spark.createDataFrame([], DOCUMENTS)
    lost = empty.select(names).unionByName(lost, allowMissingColumns=True)
    return parse_files(spark.read.format("binaryFile").load(there)).unionByName(lost) if there else lost


def flat_text(path: str, data: bytes) -> str | None:
    """A file's text without structure: text files as they stand ('' if empty), others by their parser; None for what cannot be read."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in (*TEXT_EXTENSIONS, "md"):
        return data.decode("utf-8", "ignore")
    found = parse_file(path, data) if kind in ("pdf", "docx", "ics") else {}
    return found.get("raw_text")


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of the files that can be read, empty ones too; missing and other files fall away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [flat_text(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]})

    there, empty, _ = _found(spark, paths)
    files = spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary")  # the file source leaves them out
    files = files.unionByName(spark.read.format("binaryFile").load(there).select("path", "content")) if there else files
    return files.mapInPandas(run, "path string, text string").where("text IS NOT NULL")


def _found(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(those that exist, as patterns that match nothing else; empty files; those that are missing)."""
    conf, there, empty, missing = spark.sparkContext._jsc.hadoopConfiguration(), [], [], []
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        if fs.exists(where) and not fs.getFileStatus(where).getLen() and fs.getFileStatus(where).isFile():
            empty.append(p)
        elif fs.exists(where):
            there.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", p))
        else:
            missing.append(p)
    return there, empty, missing


def flat_texts(documents: DataFrame, least: int = 50) -> DataFrame:
    """(path, raw_text) of the documents that were read and hold enough text."""
    return documents.where(F.col("error").isNull() & (F.length(strip(F.col("raw_text"))) >= least)).select("path", "raw_text")


def sections_of(documents: DataFrame) -> DataFrame:
    """(path, section_no, heading, body, level, page) of the sections that are not next to empty."""
    return documents.select("path", F.posexplode("sections").alias("section_no", "s")).select("path", "section_no", "s.*").where(F.length(strip(F.col("body"))) >= 10)


def sectionise_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, level, page, body) of text blocks(doc_id, page, block, text, size), natively.

    The most frequent size is the body's (the mean, where none repeats); larger blocks are headings and number the blocks up to the next one.
    """
    sizes = blocks.groupBy("doc_id", F.round("size", 1).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("mode"), F.max("n").alias("most"), F.avg("s").alias("mean"))
    usual = usual.select("doc_id", F.when(F.col("most") > 1, F.col("mode")).otherwise(F.col("mean")).alias("usual"))
    rows = blocks.join(usual, "doc_id").withColumn("large", F.col("size") >= HEADING_SIZE * F.col("usual"))
    rows = rows.where(~F.col("text").rlike(r"^\d+$") & ((F.length("text") >= LEAST_BLOCK) | F.col("large")))
    running = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section_no", F.sum(F.col("large").cast("int")).over(running).cast("int"))
    head = lambda c: F.max(F.when(F.col("large"), c))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("large"), F.struct("page", "block", "text")))), lambda x: x["text"]), "\n")
    out = rows.groupBy("doc_id", "section_no").agg(F.coalesce(head(F.col("text")), F.lit("")).alias("heading"), F.coalesce(head(F.when(F.col("size") >= TOP_SIZE * F.col("usual"), 1).otherwise(2)), F.lit(0)).alias("level"), F.min("page").alias("page"), body.alias("body"))
    return out.where("body != ''")


def html_facts(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """(key, title, headings, n_sections, body_chars) of pages, by the reader of HTML files; `closed` as for parse_html."""

    @F.pandas_udf("title string, headings string, n_sections int, body_chars long")
    def facts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            d = parse_html(t or "", closed) or {"title": "", "sections": []}
            s = d["sections"]
            out.append((d["title"], "|".join(x["heading"] for x in s), len(s), sum(len(x["body"]) for x in s)))
        return pd.DataFrame(out, columns=["title", "headings", "n_sections", "body_chars"])

    return pages.select(key, facts(html).alias("f")).select(key, "f.*")
