import hashlib
import io
import os
import random
import re
import time
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from graphloom.config import Config
from graphloom.functions import texts as t
from graphloom.functions.embedding import HashEmbedder, embed, embed_labels, get_embedder
from graphloom.operators.chunking import chunk_documents, chunk_text, long_enough, quality, sectionise
from graphloom.operators.extraction import STOP_WORDS, concept_edges, concept_nodes, heading_edges, metadata_nodes, phrases
from graphloom.plans.catalogue import QUERIES
from graphloom.plans.ingest import document_rows, report_lines, report_totals, simple_rows, simple_sentences
from graphloom.plans.narration import narrate, path_lines, prompts
from graphloom.sources.documents import flat_texts, parse_file, parse_html, parse_markdown, read_documents, read_folder, read_texts, sectionise_blocks
from graphloom.streaming.watch import Watcher, debounce, debounce_stream, list_files
from pyspark.sql import functions as F

PROSE = "Solar panels convert light because photons move electrons. However, clouds reduce output! Is it enough? Yes. "


def test_chunker():
    assert chunk_text("") == chunk_text("  \n ") == chunk_text(None) == []
    md = "# Title\n\nintro text\n\n## Part\nbody of part\n### Empty\n\n## Last\nthe end"
    assert [(c["heading"], c["text"]) for c in chunk_text(md)] == [("Title", "intro text"), ("Part", "body of part"), ("Last", "the end")]
    numbered = chunk_text("1. Background\nSome text.\n2. Methodology\nMore text.\nALL CAPS HEADING\nlast")
    assert [c["heading"] for c in numbered] == ["Background", "Methodology", "ALL CAPS HEADING"]
    paragraphs = chunk_text("\n\n".join(f"Paragraph {i} " + "word " * 80 for i in range(20)))
    assert len(paragraphs) >= 2 and all(3000 <= len(c["text"]) <= 6100 for c in paragraphs[:-1])
    rnd = random.Random(1)
    for text in (PROSE * 200, "x" * 20000, "word " * 5000, "".join(rnd.choice("ab .!?A\n") for _ in range(30000))):
        chunks = chunk_text(text)
        assert all(0 < len(c["text"]) <= 6000 for c in chunks)
        assert [c["position"] for c in chunks] == list(range(len(chunks)))
        assert "".join("".join(c["text"].split()) for c in chunks) == "".join(text.split())
        assert all(text[c["char_start"] :].lstrip().startswith(c["text"].split()[0]) for c in chunks)
    assert chunk_text(PROSE * 200)[0]["text"].endswith((".", "!", "?"))


def test_native_sections_and_quality(spark):
    docs = spark.createDataFrame([("a", "pre\n# One\nx\ny\n## Empty\n2.1 Two\n z \n"), ("b", "no headings"), ("c", ""), ("d", None)], "doc_id string, text string")
    out = [(r.doc_id, r.section_no, r.heading, r.char_start, r.body) for r in sectionise(docs).orderBy("doc_id", "section_no").collect()]
    assert out == [("a", 0, "", 0, "pre"), ("a", 1, "One", 4, "x\ny"), ("a", 3, "Two", 23, "z"), ("b", 0, "", 0, "no headings")]
    chunks = chunk_documents(docs)
    assert [r.text for r in chunks.where("doc_id = 'a'").orderBy("position").collect()] == ["pre", "x\ny", "z"] and long_enough(chunks).count() == 0
    assert {r.doc_id: r.poor for r in quality(chunks).collect()} == {"a": False, "b": True}


def test_sections_as_written(spark, tmp_path):
    """As the query's SQL has them: headings keep their numbers and the white space after them, and lines are judged with it."""
    text = "pre\n1.2.3.4 Name of it \nbody\n2.\tTwo \ntwo\nALL CAPS \nthree\nSHORTER\nfour\n#  \nfive\nCAPITALS ONLY\r\nsix\n# a\u2028b\nseven"
    spark.createDataFrame([(7, text), (8, None), (9, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = [(r.section_no, r.heading, r.body_chars) for r in QUERIES["markdown_sections"](spark, str(tmp_path)).orderBy("doc_id", "section_no").collect()]
    assert out == [(1, "Part 7", 3), (2, "1.2.3.4 Name of it ", 4), (3, "2.\tTwo ", 3), (4, "ALL CAPS ", 18), (5, "", 23), (6, "a\u2028b", 5)]
    headings = [r.heading for r in sectionise(spark.createDataFrame([("a", "1.2.3.4 Name of it\nbody\n2. Two \ntwo")], "doc_id string, text string")).orderBy("section_no").collect()]
    assert headings == ["Name of it", "Two"]


def test_text_functions(spark):
    row = lambda x: spark.createDataFrame([(x,)], "s string")
    types = {"It rained because of X": "causal", "big but slow": "contrastive", "made of wood": "constitutive", "they strengthen it": "sequential", "the cat sat": "semantic"}
    for text, kind in types.items():
        assert row(text).select(t.edge_type(F.col("s"))).first()[0] == kind
    assert row("wind will drive it").select(t.edge_type(F.col("s"), F.array(F.lit("drive")))).first()[0] == "causal"
    assert row("\t  Label\n").select(t.label_key(F.col("s"))).first()[0] == "label"
    assert row(" One two  three four five six Seven").select(t.first_words(F.col("s"))).first()[0] == "one two three four five six"
    assert [row(x).select(t.is_label(F.col("s"))).first()[0] for x in ("cat", "it", "they", "ab")] == [True, False, False, False]
    assert row("/a/b.c/File.TXT").select(t.extension(F.col("s")), t.base_name(F.col("s"))).first()[:] == (".txt", "File.TXT")
    paths = spark.createDataFrame([(1, 1, ["a", "b"], 0.5), (1, 2, ["a", "b", "c"], 0.421)], "query_id int, rank int, labels array<string>, conductivity double")
    lines = path_lines(paths)
    assert lines.first().lines == "Path 1 (confidence 0.50, 1 hop): a → b\nPath 2 (confidence 0.42, 2 hops): a → b → c"
    q = spark.createDataFrame([(1, "why?")], "query_id int, query string")
    for model, mark in (("phi-3", "<|user|>"), ("qwen", "<|im_start|>")):
        text = prompts(q, lines, model).first().prompt
        assert text.startswith(mark) and "why?" in text and "".join(narrate(text)) == lines.first().lines + "\n"
    assert list(narrate("x", lambda p, **k: iter([p, str(k["max_tokens"])]))) == ["x", "400"]


def test_embedders(spark):
    e = get_embedder(False)
    a, b, c = e.encode(["Wind", " wind ", "sun"])
    assert len(a) == 384 and (a == b).all() and abs((a * a).sum() - 1) < 1e-12 and abs((a * c).sum()) < 0.3
    rows = spark.createDataFrame([("x",), (None,)], "s string").select(embed(F.col("s"), HashEmbedder(8)).alias("v")).collect()
    assert len(rows[0].v) == 8 and rows[1].v is None
    nodes = spark.createDataFrame([("1", "a", None), ("2", "a", [9.0]), ("3", "b", None)], "node_id string, label string, embedding array<double>")
    out = {r.node_id: r.embedding for r in embed_labels(nodes, HashEmbedder(4)).collect()}
    assert len(out["1"]) == 4 and out["2"] == [9.0] and out["3"] != out["1"]


def test_html():
    page = "<html><head><title>The Page</title><style>p {color: red}</style></head><body><nav>menu<br>more<img src=x></nav><p>Before</p><h1>First &amp; only</h1><p>one <b>two</b></p><script>alert('</p>')</script><h2>Empty</h2><h2>Second</h2><footer>foot</footer>text<br>end</body></html>"
    d = parse_html(page)
    assert d["title"] == "The Page"
    assert [(s["heading"], s["body"], s["level"]) for s in d["sections"]] == [("", "Before", 0), ("First & only", "one two", 1), ("Second", "text end", 2)]
    assert parse_html("") is None and parse_html("<nav>only menu")["sections"][0]["body"] == "only menu"


def test_html_references_without_semicolon(spark, tmp_path):
    """As the queries' SQL reads them: an escaped title that was cut off keeps what is left of its last reference. Files are read as browsers do."""
    page = "<html><head><title>A &amp; B &amp</title></head><body><p>Pre &quot</p><h1>C &lt;x&gt; &#39;d&#39; &amp</h1><p>e &ampf &notit; &unknown; & g</p><h1>H&am</h1>i&copy;</body></html>"
    d = parse_html(page, closed=True)
    assert d["title"] == "A & B &amp"
    assert [(s["heading"], s["body"]) for s in d["sections"]] == [("", "Pre &quot"), ("C <x> 'd' &amp", "e &ampf &notit; &unknown; & g"), ("H&am", "i\u00a9")]
    assert parse_html(page)["title"] == "A & B &"
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.title for r in QUERIES["html_title"](spark, str(tmp_path)).collect()} == {1: "A & B &amp", 2: ""}
    assert QUERIES["html_sections"](spark, str(tmp_path)).where("page_id = 1").first().headings == "|C <x> 'd' &amp|H&am"


def docx(parts, title="T"):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", f'<cp:x xmlns:cp="c" xmlns:dc="d"><dc:title>{title}</dc:title><dc:creator>Ada</dc:creator></cp:x>')
    return out.getvalue()


ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART;TZID=UTC:20240101T100000\r\nSUMMARY:Meet\\, talk\r\nDESCRIPTION:A long\r\n  line\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Only\r\nEND:VEVENT\r\nEND:VCALENDAR"


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.txt": b"Plain text \xff of a file that is long enough to count as one.", "b.md": b"# The Title\n\nIntro\n\n## My part\nBody text here.", "c.html": b"<h1>Head</h1><p>Body of page</p>", "d.docx": docx([("Heading1", "Intro"), ("Normal", "Some words"), ("Title", "Big"), ("Normal", "More words")]), "sub/e.ics": ICS.encode(), "f.txt": b"  ", "g.docx": b"broken", "h.xyz": b"no", "i.csv": b"x,y\n1,2"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    out = {r.path.rsplit("/", 1)[1]: r for r in read_folder(spark, str(tmp_path)).collect()}
    assert set(out) == {"a.txt", "b.md", "c.html", "d.docx", "e.ics", "f.txt", "g.docx", "i.csv"}
    assert out["b.md"].title == "The Title" and [s.heading for s in out["b.md"].sections] == ["The Title", "My part"]
    assert [(s.heading, s.level) for s in out["d.docx"].sections] == [("Intro", 1), ("Big", 0)] and out["d.docx"].author == "Ada"
    assert out["e.ics"].raw_text == "20240101T100000. Meet, talk. A long line\nOnly"
    assert out["f.txt"].error == "no text" and "BadZipFile" in out["g.docx"].error and out["a.txt"].raw_text.startswith("Plain text  of")
    assert "e.ics" not in {r.path.rsplit("/", 1)[1] for r in read_folder(spark, str(tmp_path), recursive=False).collect()}
    docs = read_documents(spark, [str(tmp_path / "a.txt"), str(tmp_path / "gone.txt")])
    assert {r.error for r in docs.collect()} == {None, "no such file"}
    assert flat_texts(docs).count() == 1 and read_documents(spark, []).count() == 0
    with pytest.raises(ValueError):
        read_folder(spark, str(tmp_path / "a.txt"))
    assert "unsupported" in parse_file("x.xyz", b"")["error"] and parse_markdown("  ") is None
    assert parse_file("x.pdf", b"%PDF-1.4 broken")["error"]


def test_pdf_blocks_to_sections(spark):
    rows = [(1, 1, 0, "Paper", 20.0), (1, 1, 1, "First body block of text, long", 10.0), (1, 1, 2, "7", 10.0), (1, 2, 0, "short", 10.0), (1, 2, 1, "Methods", 12.0), (1, 2, 2, "Second body block of text, long", 10.0), (1, 2, 3, "Third body block of text, long", 10.0)]
    out = sectionise_blocks(spark.createDataFrame(rows, "doc_id int, page int, block int, text string, size double")).orderBy("section_no").collect()
    assert [(r.heading, r.level, r.page) for r in out] == [("Paper", 1, 1), ("Methods", 2, 2)] and out[1].body.count("\n") == 1


def test_pdf_by_characters(monkeypatch):
    """The body's size is that of most characters, not of most blocks; without sizes or sections the whole text is one section."""
    from graphloom.sources import documents as d

    body = "A long block of body text that has many characters of one size."
    blocks = [(1, 0, "Paper", [20.0] * 5), (1, 1, body, [10.0] * 60), (1, 2, "7", [9.0]), (1, 3, "note", [9.0] * 4), (1, 4, "last", [9.0] * 4), (2, 0, "Methods", [12.0] * 7), (2, 1, body, [10.0] * 60)]
    monkeypatch.setattr(d, "pdf_blocks", lambda data: blocks)
    monkeypatch.setattr(d, "pdf_text", lambda data: "all of it")
    assert [(s["heading"], s["level"], s["page"], s["body"]) for s in d.parse_pdf(b"")["sections"]] == [("Paper", 1, 1, body), ("Methods", 2, 2, body)]
    monkeypatch.setattr(d, "pdf_blocks", lambda data: [(1, 0, "x", [])])
    assert d.parse_pdf(b"")["sections"][0]["body"] == "all of it"

    def fails(data):
        raise ValueError("layout")

    monkeypatch.setattr(d, "pdf_blocks", fails)
    assert d.parse_pdf(b"")["sections"][0]["body"] == "all of it"


def test_flat_texts_of_files(spark, tmp_path):
    for name, data in {"empty.txt": b"", "a [1].md": b"# Head\nBody \xff", "b.xyz": b"no", "c.docx": b"broken", "d.ics": ICS.encode()}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r.text for r in read_texts(spark, [str(p) for p in tmp_path.iterdir()] + [str(tmp_path / "gone.txt")]).collect()}
    assert set(found) == {"empty.txt", "a [1].md", "d.ics"} and found["empty.txt"] == "" and found["a [1].md"] == "# Head\nBody "
    assert read_texts(spark, []).count() == 0


def test_extraction(spark):
    chunks = spark.createDataFrame([("d", 0, 0, "The solar panel converts light because the Grid Company needs power. It is made of glass and metal. Then we left")], "doc_id string, section_no int, position int, text string")
    found = phrases(chunks)
    nodes = {r.label: r for r in concept_nodes(found).collect()}
    assert {"solar panel converts light", "grid company needs power", "glass", "metal"} <= set(nodes)
    assert nodes["grid company needs power"].node_type == "entity" and nodes["grid company needs power"].activation == 0.75 and nodes["metal"].node_type == "concept"
    kinds = {r.sentence_no: r.edge_type for r in concept_edges(found).collect()}
    assert kinds == {0: "causal", 1: "constitutive"}


def test_causal_verbs_type_edges(spark):
    kinds = {"Strong wind and sun drives prices of power": "causal", "Heat for weeks caused stress in plants": "causal", "Rain in spring led rivers to towns": "causal", "Storms were DRIVEN by heat": "causal", "People of towns, enabling trade": "causal", "The cause of heat was wind": "semantic", "Its results were sold to towns": "semantic", "Misled people saw causeways in towns": "semantic", "A driver of trucks": "semantic", "Wind drives prices but heat falls": "contrastive"}
    chunks = spark.createDataFrame([(s, 0, 0, s) for s in kinds], "doc_id string, section_no int, position int, text string")
    found = {r.doc_id: r.edge_type for r in concept_edges(phrases(chunks)).collect()}
    assert found == kinds


def brute_extraction(docs):
    """Concepts and edges of documents, word by word."""
    concepts, edges = Counter(), Counter()
    for doc_id, text in docs:
        ident = lambda label, doc_id=doc_id: hashlib.sha256(f"{doc_id}|{label}".encode()).hexdigest()[:32]
        for chunk in chunk_text(text):
            if len(chunk["text"]) < 50:
                continue
            found = {}
            for sentence in re.split(t.SENTENCE_END, chunk["text"]):
                kinds = [("causal", t.CAUSAL_MARKS), ("contrastive", t.CONTRAST_MARKS), ("constitutive", t.CONSTITUTIVE_MARKS), ("sequential", t.SEQUENCE_MARKS)]
                kind = next((k for k, marks in kinds if any(m in sentence.lower() for m in marks)), "semantic")
                held = [""]
                for word in re.findall(r"[\w'-]+|\s+|[^\w\s'-]+", sentence):
                    if word.lower() in STOP_WORDS or not re.match(r"[\w\s'-]", word):
                        held.append("")
                    else:
                        held[-1] += word
                chain = [x.strip() for x in held if x.strip()]
                for phrase in chain:
                    if len(phrase) >= 3 and phrase.lower() not in t.PRONOUNS:
                        found[phrase.lower()] = found.get(phrase.lower(), False) or phrase[0].isupper() and not sentence.startswith(phrase)
                for a, b in zip(map(str.lower, chain), map(str.lower, chain[1:]), strict=False):
                    if a != b and min(len(a), len(b)) >= 3 and a not in t.PRONOUNS and b not in t.PRONOUNS:
                        edges[str(doc_id), ident(a), ident(b), kind] += 1
            for label, entity in found.items():
                concepts[str(doc_id), label, "entity" if entity else "concept", 0.75 if entity else 0.70] += 1
    return concepts, edges


def test_extraction_from_documents(spark, tmp_path):
    sections = "# Energy\n\n" + PROSE * 2 + "\n## Tiny\nshort\n2.1 Storage\nThe Grid Company keeps batteries, cells and ox as reserve; it sells them to Big City.\n" + "Then power is made of light and wind. " * 3
    accents = "Die größte Mühle steht über Österreich, weil Wärme fließt. Élan vital et l'été, né à Paris and made of pâté. " * 2
    docs = [(1, PROSE * 100), (2, sections), (3, sections), (4, ""), (5, None), (6, "too short"), (7, accents), (8, "word and thing or idea " * 400), (9, "\n\n".join(f"Paragraph {i} of Mills. " + "Wind and sun are power. " * 40 for i in range(12)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name: Counter(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    concepts, edges = brute_extraction(docs)
    assert {i for i, *_ in concepts} == {"1", "2", "3", "7", "8", "9"} and "élan vital et l'été" in {x[1] for x in concepts}
    assert rows("extract_concepts") == concepts and rows("extract_edges") == edges


def test_metadata_and_heading_edges(spark):
    doc = [("p", "The Title", "Ada", "", "md", "", [("Introduction", "x", 1, 0), ("Results", "y", 1, 0), ("results ", "z", 1, 0), ("", "w", 0, 0)], None)]
    docs = spark.createDataFrame(doc, "path string, title string, author string, date string, format string, raw_text string, sections array<struct<heading: string, body: string, level: int, page: int>>, error string")
    meta = metadata_nodes(docs)
    assert sorted((r.role, r.label) for r in meta.collect()) == [("author", "ada"), ("heading", "introduction"), ("heading", "results"), ("title", "the title")]
    assert all(r.protected and r.activation == 0.9 for r in meta.collect())
    head = meta.where("label = 'results'").first().node_id
    nodes = spark.createDataFrame([("p", "n1", " RESULTS"), ("p", "n2", "none"), ("p", head, "Results"), ("p", "n3", None)], "doc_id string, node_id string, heading string")
    assert [(r.src, r.dst, r.edge_type) for r in heading_edges(nodes, meta).collect()] == [("n1", head, "constitutive")]


def test_ingest_report(spark, tmp_path):
    (tmp_path / "good.md").write_text("# Energy\n\n" + PROSE * 3 + "\n\n## Storage\n\n" + "Batteries hold power since demand varies. " * 3)
    (tmp_path / "short.txt").write_text("too short")
    docs = read_documents(spark, [str(tmp_path / "good.md"), str(tmp_path / "short.txt"), str(tmp_path / "gone.md")])
    nodes, edges, report = document_rows(docs, HashEmbedder(8))
    totals = report_totals(report).first()
    assert totals.files_ok == 1 and totals.files_failed == 2 and totals.total_nodes == nodes.count() > 5
    lines = {r.path.rsplit("/", 1)[1]: r.line for r in report_lines(report).collect()}
    assert lines["good.md"].startswith("  OK  good.md  [md]  2 chunks") and "FAILED" in lines["short.txt"] and "no such file" in lines["gone.md"]
    ids = {r.node_id for r in nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in edges.collect()) and edges.where("edge_type = 'constitutive'").count() > 0
    assert nodes.where("embedding IS NULL").count() == 0


def test_simple_text(spark):
    docs = spark.createDataFrame([(1, "First sentence is here. Second sentence\nis there. Tiny. Third sentence is last."), (2, "no"), (3, None)], "doc_id int, text string")
    s = simple_sentences(docs)
    assert [(r.i, r.n, r.label) for r in s.orderBy("i").collect()] == [(0, 3, "first sentence is here"), (1, 3, "second sentence is there"), (2, 3, "third sentence is last")]
    v = s.select("doc_id", "i", F.array(F.lit(1.0)).alias("v"))
    nodes, edges = simple_rows(s, v)
    assert {r.node_id: round(r.recency, 6) for r in nodes.collect()} == {"1:0": 1.0, "1:1": 0.933333, "1:2": 0.866667}
    assert sorted((r.src, r.dst, r.edge_type, round(r.base_weight, 4)) for r in edges.collect()) == [("1:0", "1:1", "sequential", 0.7), ("1:0", "1:2", "semantic", 0.55), ("1:1", "1:2", "sequential", 0.7)]


def test_debounce(spark):
    rnd, base = random.Random(4), datetime(2024, 1, 1)
    rows = [(k, base + timedelta(milliseconds=rnd.randrange(200_000))) for k in "abc" for _ in range(60)] + [("d", base), ("d", base), (None, base), ("d", None)]
    out = debounce(spark.createDataFrame(rows, "path string, ts timestamp"), 10)
    wanted = []
    for k in "abcd":
        last = None
        for ts in sorted({x for key, x in rows if key == k and x}):
            if last is None or ts - last >= timedelta(seconds=10):
                wanted.append((k, ts))
                last = ts
    assert sorted(map(tuple, out.collect())) == sorted(wanted)


def test_debounce_of_a_stream(spark, tmp_path):
    """The same events in three batches: the rule of the batch form, and what comes late lies inside the pause."""
    base = datetime(2024, 1, 1)
    events = [(k, base + timedelta(seconds=n)) for k, n in (("a", 0), ("a", 4), ("b", 1), ("a", 9), ("a", 10), ("a", 19), ("b", 30), ("a", 21), ("b", 39), ("b", 41), ("a", 100))]
    for i in range(3):
        part = spark.createDataFrame(events[4 * i : 4 * i + 4], "path string, ts timestamp").coalesce(1)
        part.write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        file = next((tmp_path / str(i)).glob("*.parquet"))
        file.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = debounce_stream(stream, 10).writeStream.format("memory").queryName("debounced").trigger(availableNow=True).start()
    query.awaitTermination(180)
    found = sorted(map(tuple, spark.table("debounced").collect()))
    assert found == sorted(map(tuple, debounce(spark.createDataFrame(events, "path string, ts timestamp"), 10).collect()))
    assert [(k, (t - base).seconds) for k, t in found] == [("a", 0), ("a", 10), ("a", 21), ("a", 100), ("b", 1), ("b", 30), ("b", 41)]


def test_watcher(spark, tmp_path):
    folder, taken = tmp_path / "in", []
    words = " document that is certainly long enough to be taken in."
    with pytest.raises(ValueError):
        list_files(spark, str(folder))
    folder.mkdir()
    (folder / "one.txt").write_text("A first" + words)
    (folder / "short.txt").write_text("short")
    (folder / "skip.xyz").write_text("x" * 100)

    def ingest(documents):
        new = [(r.path.rsplit("/", 1)[1], r.raw_text) for r in documents.collect()]
        taken.extend(new)
        if "bad.txt" in dict(new):
            raise RuntimeError("no")

    def run(seconds):
        return Watcher(spark, str(folder), str(tmp_path / "state"), ingest, seconds=seconds, trigger="0 seconds").start()

    w = run(0)
    try:
        w.drain()
        assert [n for n, _ in taken] == ["one.txt"] and w.stats() == {"ingested": 1, "failed": 1, "batches": 1, "waiting": 0}
        (folder / "two.md").write_text("# Two\n\nA second" + words)
        (tmp_path / "old [1].txt").write_text("An old" + words)
        os.utime(tmp_path / "old [1].txt", (1000, 1000))
        (tmp_path / "old [1].txt").rename(folder / "old [1].txt")  # moved in, with a time long past
        w.drain()
        assert sorted(n for n, _ in taken) == ["old [1].txt", "one.txt", "two.md"] and w.is_alive()
        (folder / "one.txt").write_text("A changed first" + words)  # changed in place
        (folder / "short.txt").write_text("No longer short, this" + words)
        w.drain()
        assert taken[3:] and sorted(taken[3:]) == [("one.txt", "A changed first" + words), ("short.txt", "No longer short, this" + words)]
        assert w.stats()["ingested"] == 5 and w.stats()["failed"] == 1
    finally:
        w.stop()
    assert not w.is_alive()
    w = run(0)  # goes on from its table
    try:
        (folder / "bad.txt").write_text("A third document, which the session cannot take in for some reason.")
        w.drain()
        assert [n for n, _ in taken].count("one.txt") == 2 and w.is_alive() and w.stats() == {"ingested": 0, "failed": 1, "batches": 1, "waiting": 0}
    finally:
        w.stop()
    assert Config().debounce_seconds == 10


def test_changes_within_the_pause_wait(spark, tmp_path):
    folder, taken = tmp_path / "in", []
    folder.mkdir()
    words = " document that is certainly long enough to be taken in."
    w = Watcher(spark, str(folder), str(tmp_path / "state"), lambda d: taken.extend(r.raw_text for r in d.collect()), seconds=15, trigger="0 seconds").start()
    try:
        (folder / "a.txt").write_text("One" + words)
        w.drain()
        began = time.time()
        for n in ("Two", "Three"):
            (folder / "a.txt").write_text(n + words)
            time.sleep(2)
        assert taken == ["One" + words] and time.time() - began < 14
        w.drain()  # the pause ends, and the last state of the file is read, once
        assert taken == ["One" + words, "Three" + words] and w.stats() == {"ingested": 2, "failed": 0, "batches": 2, "waiting": 0}
        (folder / "a.txt").unlink()
        w.drain()
        assert len(taken) == 2
    finally:
        w.stop()
