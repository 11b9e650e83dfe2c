"""Files to parsed documents: a router by extension, with parsers from the standard library.

Formats that need a library which isn't there (PDF, OCR, legacy office files) come out with the status that says so;
their page texts can be given through ``page_texts``.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

PARSED_SCHEMA = "path string, filename string, type string, status string, text string, tables array<struct<name:string,rows:array<array<string>>,units:map<string,string>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SKIP = r"(?i)(^|/)(\.[^/]*|~\$[^/]*|\$recycle\.bin|__pycache__|node_modules|system volume information|thumbs\.db)(/|$)"


def scan_files(spark: SparkSession, root: str, *, most: int | None = None) -> DataFrame:
    """Inventory of a folder: path, path under the folder, file name, extension, size, time, topic (its first folder, without a leading
    number), category and why a file won't be parsed; contents aren't read. Hidden and system entries are left out. With
    ``most``, only the first files by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    base = files.where(~F.col("path").rlike(_SKIP)).select("path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), ext.alias("_e"))
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    under = F.regexp_replace(F.substr(plain, F.length(F.lit(root.rstrip("/"))) + 1), "^/+", "")
    category = F.lit("unknown")
    for kind, members in vocab.CATEGORIES.items():
        category = F.when(F.col("_e").isin(members), kind).otherwise(category)
    topic = F.when(F.contains("relative_path", F.lit("/")), F.nullif(F.regexp_replace(F.split_part("relative_path", F.lit("/"), F.lit(1)), r"^[0-9.\-_ ]+", ""), F.lit("")))
    reason = F.when(F.col("_e").isin(vocab.PARSED), F.lit(None)).when(F.col("category") == "cad_engineering", "metadata_only_cad").when(F.col("category") == "archives", "metadata_only_archive").otherwise("unsupported_extension")
    out = base.withColumn("relative_path", under).withColumns({"topic": F.coalesce(topic, F.lit("Unsorted")), "category": category}).withColumn("skipped_reason", reason).drop("_e")
    return out.orderBy("path").limit(most) if most else out


def unit_of_header(header: str) -> str | None:
    m = re.search(r"\[([^\]]+)\]\s*$", header or "")
    return m[1].strip() if m else None


def _table(name: str, rows: list[list[str]]) -> dict:
    width = max((len(r) for r in rows), default=0)
    rows = [[("" if c is None else str(c)) for c in r] + [""] * (width - len(r)) for r in rows]
    return {"name": name, "rows": rows, "units": {h: u for h in (rows[0] if rows else []) if (u := unit_of_header(h))}}


def parse_csv(data: bytes, name: str) -> tuple[str, list[dict]]:
    text = data.decode("utf-8-sig", "replace")
    sample = text.split("\n", 1)[0]
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=max(",;\t", key=sample.count)) if r]
    tab = _table(name, rows)
    return summary(tab), [tab]


def summary(tab: dict) -> str:
    return f"Tabelle '{tab['name']}': {max(0, len(tab['rows']) - 1)} Zeilen, Spalten: {', '.join(tab['rows'][0]) if tab['rows'] else ''}"


def parse_docx(data: bytes, name: str) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    words = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    tables, inside = [], set()
    for i, t in enumerate(body.iter(_W + "tbl")):
        tables.append(_table(f"table_{i}", [[words(c) for c in r.iter(_W + "tc")] for r in t.iter(_W + "tr")]))
        inside.update(id(p) for p in t.iter(_W + "p"))
    lines = [words(p) for p in body.iter(_W + "p") if id(p) not in inside]
    return "\n".join(x for x in lines if x.strip()), tables


def parse_xlsx(data: bytes, name: str) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(_S + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
        tables = []
        for i, title in enumerate(titles):
            rows = []
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i + 1}.xml")).iter(_S + "row"):
                cells: list[str] = []
                for c in r.iter(_S + "c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = c.find(_S + "v")
                    inline = "".join(t.text or "" for t in c.iter(_S + "t"))
                    cells.append(inline if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                rows.append(cells)
            tables.append(_table(title, rows))
    return "\n".join(summary(t) for t in tables), tables


def parse_pptx(data: bytes, name: str, least: int = 100, least_notes: int = 20) -> tuple[str, list[dict]]:
    """Slides as text: the title on a line of its own, the other shapes' text, and notes of more than ``least_notes`` characters; tables of
    slides as tables. A slide with less than ``least`` characters goes together with those after it until they have as many."""
    lines = lambda e: [t for p in e.iter(_A + "p") if (t := "".join(x.text or "" for x in p.iter(_A + "t"))).strip()]
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    tables, slides = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        for file in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            slide, out, in_table = ElementTree.fromstring(z.read(file)), [], set()
            for i, tab in enumerate(slide.iter(_A + "tbl")):
                rows = [[" ".join(lines(c)) for c in r.iter(_A + "tc")] for r in tab.iter(_A + "tr")]
                tables.append(_table(f"slide_{number(file)}_table" + (f"_{i}" if i else ""), rows))
                in_table.update(id(p) for p in tab.iter(_A + "p"))
            for shape in slide.iter(_P + "sp"):
                kind = next((ph.get("type", "") for ph in shape.iter(_P + "ph")), None)
                got = [t for p in shape.iter(_A + "p") if id(p) not in in_table and (t := "".join(x.text or "" for x in p.iter(_A + "t"))).strip()]
                out += [f"Title: {' '.join(got)}"] if kind in ("title", "ctrTitle") and got else got
            notes = file.replace("slides/slide", "notesSlides/notesSlide")
            if notes in names and len(said := " ".join(lines(ElementTree.fromstring(z.read(notes))))) > least_notes:
                out.append(f"Notes: {said}")
            slides.append("\n".join(out))
    merged, now = [], ""
    for s in slides:
        now = f"{now}\n{s}".strip()
        if len(now) >= least:
            merged.append(now)
            now = ""
    return "\n\n".join([*merged, now] if now else merged), tables


def parse_url(data: bytes, name: str) -> tuple[str, list[dict]]:
    m = re.search(r"(?im)^url=(.*)$", data.decode("utf-8", "replace"))
    return (m[1].strip() if m else ""), []


def parse_text(data: bytes, name: str) -> tuple[str, list[dict]]:
    return data.decode("utf-8", "replace"), []


PARSERS = {"csv": parse_csv, "docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx, "url": parse_url, "txt": parse_text, "md": parse_text, "html": parse_text}
NEEDS_LIBRARY = {"pdf": "needs_pdf_library", "png": "needs_ocr", "jpg": "needs_ocr", "jpeg": "needs_ocr", "doc": "needs_converter", "ppt": "needs_converter", "xls": "needs_converter"}


def parse_files(spark: SparkSession, root: str, *, page_readers: dict | None = None, captioner=None) -> DataFrame:
    """All files of a folder parsed, one row each with ``status``: parsed, parse_error, unsupported, or what it would need. A
    damaged file doesn't fail the job.

    ``page_readers`` gives for an extension (pdf, png, doc ...) a function from a file's bytes to the texts of its pages, which is where a
    library for it is plugged in; ``captioner`` one from an image file's bytes to a caption, which is added to its text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").rlike(_SKIP)).select("path", "content")
    readers = page_readers or {}

    def parse(ext: str, data: bytes, stem: str) -> tuple[str, list[dict]]:
        if ext not in readers:
            return PARSERS[ext](data, stem)
        text = "\n".join(f"[PAGE_BREAK:{i}]{t}" for i, t in enumerate(readers[ext](data), 1) if t is not None)
        return text + (f"\n[Figure p.1/1]: {captioner(data)}" if captioner and ext in ("png", "jpg", "jpeg") else ""), []

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                text, tables, status = None, [], NEEDS_LIBRARY.get(ext, "unsupported")
                if ext in PARSERS or ext in readers:
                    try:
                        text, tables = parse(ext, bytes(data), name.rsplit(".", 1)[0])
                        status = "parsed"
                    except Exception:  # noqa: BLE001  whatever a damaged file raises
                        status = "parse_error"
                out.append((path, name, ext, status, text, tables))
            yield pd.DataFrame(out, columns=["path", "filename", "type", "status", "text", "tables"])

    return files.mapInPandas(run, PARSED_SCHEMA)


def page_texts(pages: DataFrame, *, key: str = "path") -> DataFrame:
    """Texts of pages (key, page, text), from whatever reads them, as one text each with page marks."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    mark = F.transform(parts, lambda p: F.concat(F.lit("[PAGE_BREAK:"), p["page"].cast("string"), F.lit("]"), F.coalesce(p["text"], F.lit(""))))
    return pages.groupBy(key).agg(F.array_join(mark, "\n").alias("text"))
