"""Document extraction: parsers by extension, the exploded block and cell tables, quality scores and the policy."""

from __future__ import annotations

import csv
import html.parser
import io
import json
import re
import xml.parsers.expat
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidwork.functions.text import is_suspicious, numeric_tokens
from braidwork.sources.folders import shared_folder

MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 500_000, 2_000, 5_000_000
MAX_PARAGRAPHS, MAX_SHEETS, MAX_NODES, MAX_ALIASES = 200_000, 200, 1_000_000, 1_000
MAX_ZIP_BYTES, MAX_ZIP_RATIO = 300 << 20, 200
#: Languages of source files.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "cpp": "cpp", "cs": "csharp", "go": "go", "php": "php", "rb": "ruby", "sh": "bash", "css": "css",
}
#: Backends of an extension, in order.
ROUTES = {
    "csv": ("csv",), "json": ("json",), "yaml": ("yaml",), "yml": ("yaml",), "xml": ("xml",), "xlsx": ("xlsx",), "xlsm": ("xlsx",), "txt": ("text",), "md": ("markdown",), "html": ("html",), "htm": ("html",), "rst": ("rst",),
    **{x: ("source",) for x in LANGUAGES},
}

#: Bytes of files whose parsed form is held at once.
BATCH_BYTES = 4 << 20
BLOCK = "struct<ordinal:int,type:string,text:string,level:int,parent:int,language:string>"
CELL = "struct<block:int,row:int,column:int,text:string,header:boolean,row_span:int,column_span:int>"
DOCUMENT = f"status string, error string, backend string, title string, blocks array<{BLOCK}>, cells array<{CELL}>"


class Failure(Exception):
    """An extraction error: code, then text."""


def limit(ok: bool, what: str) -> None:
    if not ok:
        raise Failure("RESOURCE_LIMIT_EXCEEDED", what)


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


class Builder:
    def __init__(self) -> None:
        self.blocks: list[dict[str, object]] = []
        self.cells: list[dict[str, object]] = []
        self.title: str | None = None

    def add(self, kind: str, text: str | None, level: int | None = None, parent: int | None = None, language: str | None = None) -> int:
        self.blocks.append({"ordinal": len(self.blocks), "type": kind, "text": text, "level": level, "parent": parent, "language": language})
        if kind == "title" and self.title is None:
            self.title = text
        return len(self.blocks) - 1

    def table(self, rows: list[list[str]], header: int = 0, spans: dict[tuple[int, int], tuple[int, int]] | None = None, covered: frozenset[tuple[int, int]] = frozenset()) -> None:
        limit(len(rows) <= MAX_ROWS and max(map(len, rows), default=0) <= MAX_COLUMNS and sum(map(len, rows)) <= MAX_CELLS, "table")
        at = self.add("table", None)
        for r, row in enumerate(rows):
            for c, text in enumerate(row):
                if (r, c) not in covered:
                    down, across = (spans or {}).get((r, c), (1, 1))
                    self.cells.append({"block": at, "row": r, "column": c, "text": text, "header": r == header, "row_span": down, "column_span": across})


def parse_csv(content: bytes, b: Builder) -> None:
    """All values are strings; a row longer than the header is an error, a shorter one is padded."""
    rows = [r for r in csv.reader(io.StringIO(decoded(content))) if r]
    if not rows:
        raise Failure("INVALID_CONTENT", "no rows")
    width = len(rows[0])
    if any(len(r) > width for r in rows):
        raise Failure("INVALID_CONTENT", "a row is longer than the header")
    seen: dict[str, int] = {}
    head = []
    for name in rows[0]:
        n = seen[name] = seen.get(name, -1) + 1
        head.append(f"{name}.{n}" if n else name)
    b.table([head, *[r + [""] * (width - len(r)) for r in rows[1:]]])


def count_nodes(value: object) -> int:
    n, stack = 0, [value]
    while stack:
        x = stack.pop()
        n += 1
        limit(n <= MAX_NODES, "nodes")
        stack.extend(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())
    return n


def parse_json(content: bytes, b: Builder) -> None:
    try:
        value = json.loads(decoded(content))
        count_nodes(value)
        b.add("code", json.dumps(value, indent=2, ensure_ascii=False), language="json")
    except RecursionError as e:
        raise Failure("RESOURCE_LIMIT_EXCEEDED", "nesting") from e
    except ValueError as e:
        raise Failure("INVALID_CONTENT", str(e)) from e


def parse_yaml(content: bytes, b: Builder) -> None:
    import yaml

    try:
        text = content.decode("utf-8-sig")
        limit(len(re.findall(r"(?:^|[\s\[{,:-])[&*][A-Za-z0-9_-]+", text)) <= MAX_ALIASES, "anchors and aliases")
        value = yaml.safe_load(text)
        count_nodes(value)
        b.add("code", yaml.safe_dump(value, sort_keys=False, allow_unicode=True), language="yaml")
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise Failure("INVALID_CONTENT", str(e)[:200]) from e


def parse_xml(content: bytes, b: Builder) -> None:
    """No document type, so no entities; indented anew."""
    p, out, depth, n, open_ = xml.parsers.expat.ParserCreate(), [], [0], [0], [False]

    def refuse(*_: object) -> None:
        raise Failure("INVALID_CONTENT", "document types are not allowed")

    def start(name: str, attributes: dict[str, str]) -> None:
        n[0] += 1
        limit(n[0] <= MAX_NODES, "elements")
        out.append("\n" * bool(out) + "  " * depth[0] + f"<{name}" + "".join(f' {k}="{html_escape(v)}"' for k, v in attributes.items()) + ">")
        depth[0] += 1
        open_[0] = True

    def end(name: str) -> None:
        depth[0] -= 1
        out.append(f"</{name}>" if open_[0] else "\n" + "  " * depth[0] + f"</{name}>")
        open_[0] = False

    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda t: out.append(html_escape(t.strip())) if t.strip() else None
    try:
        p.Parse(content, True)
    except xml.parsers.expat.ExpatError as e:
        raise Failure("INVALID_CONTENT", str(e)) from e
    b.add("code", "".join(out), language="xml")


def html_escape(t: str) -> str:
    import html

    return html.escape(t, quote=True)


def checked_zip(content: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Failure("INVALID_CONTENT", str(e)) from e
    entries = z.infolist()
    limit(sum(i.file_size for i in entries) <= MAX_ZIP_BYTES and all(i.file_size <= MAX_ZIP_RATIO * max(i.compress_size, 1) for i in entries), "compressed content")
    return z


def parse_xlsx(content: bytes, b: Builder) -> None:
    """A heading and a table a sheet; merged cells become spans; the header is the first row that is no full-width banner."""
    import xml.etree.ElementTree as ET

    z, ns = checked_zip(content), {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def tree(name: str) -> ET.Element:
        raw = z.read(name)
        if b"<!DOCTYPE" in raw:
            raise Failure("INVALID_CONTENT", "document types are not allowed")
        return ET.fromstring(raw)

    try:
        book = tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
    except (KeyError, ET.ParseError) as e:
        raise Failure("INVALID_CONTENT", str(e)) from e
    shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = book.findall("m:sheets/m:sheet", ns)
    limit(len(sheets) <= MAX_SHEETS, "sheets")

    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()  # type: ignore[union-attr]
        c = 0
        for x in letters:
            c = c * 26 + ord(x) - 64
        return int(digits) - 1, c - 1

    for s in sheets:
        b.add("heading", s.get("name"), 1)
        target = (targets[s.get(rel)] or "").lstrip("/")
        sheet = tree(target if target.startswith("xl/") else f"xl/{target}")
        values: dict[tuple[int, int], str] = {}
        for c in sheet.iter(f"{{{ns['m']}}}c"):
            v, kind = c.find("m:v", ns), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else (shared[int(v.text)] if kind == "s" else v.text or "") if v is not None and v.text is not None else ""
            values[place(c.get("r") or "A1")] = text
        if not values:
            continue
        height, width = max(r for r, _ in values) + 1, max(c for _, c in values) + 1
        spans, covered = {}, set()
        for m in sheet.findall("m:mergeCells/m:mergeCell", ns):
            (r0, c0), (r1, c1) = (place(x) for x in (m.get("ref") or "A1:A1").split(":"))
            spans[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            covered |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        header = next((r for r in range(height) if spans.get((r, 0), (1, 1))[1] < width or width == 1), 0)
        b.table([[values.get((r, c), "") for c in range(width)] for r in range(height)], header, spans, frozenset(covered))


def parse_text(content: bytes, b: Builder) -> None:
    parts = [p.strip() for p in decoded(content).replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    parts = [p for p in parts if p]
    limit(len(parts) <= MAX_PARAGRAPHS, "paragraphs")
    for p in parts:
        b.add("paragraph", p)


def parse_markdown(content: bytes, b: Builder) -> None:
    lines, held, listed, i = decoded(content).replace("\r\n", "\n").split("\n"), [], None, 0

    def flush() -> None:
        if held:
            b.add("paragraph", " ".join(held))
            held.clear()

    while i < len(lines):
        line = lines[i]
        head, item = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line), re.match(r"\s*(?:([-*+])|\d+[.)])\s+(.*)", line)
        if line.startswith("```"):
            flush()
            j = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            b.add("code", "\n".join(lines[i + 1 : j]), language=line[3:].strip() or None)
            i, listed = j + 1, None
            continue
        if "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[i + 1]):
            flush()
            j = i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
            b.table([[c.strip() for c in x.strip().strip("|").split("|")] for x in (line, *lines[i + 2 : j])])
            i, listed = j, None
            continue
        if head:
            flush()
            level = len(head[1])
            b.add("title" if level == 1 and b.title is None else "heading", head[2], level)
            listed = None
        elif item:
            flush()
            kind = "unordered" if item[1] else "ordered"
            if listed is None or listed[0] != kind:
                listed = (kind, b.add("list", None))
            b.add("list_item", item[2], parent=listed[1])
        elif line.strip():
            held.append(line.strip())
            listed = None
        else:
            flush()
            listed = listed if i + 1 < len(lines) and re.match(r"\s*(?:[-*+]|\d+[.)])\s", lines[i + 1]) else None
        i += 1
    flush()


class _Html(html.parser.HTMLParser):
    """Block elements to blocks; head, scripts and styles are no text."""

    BLOCKS = {"p": "paragraph", "li": "list_item", "pre": "code", "td": "cell", "th": "cell", "figcaption": "caption", **{f"h{i}": "heading" for i in range(1, 7)}}

    def __init__(self, b: Builder) -> None:
        super().__init__(convert_charrefs=True)
        self.b, self.text, self.tag, self.skip = b, [], None, 0
        self.lists: list[int] = []
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append(self.b.add("list", None))
        elif tag == "table":
            self.close_block()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in self.BLOCKS:
            self.close_block()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists and self.lists.pop()
        elif tag == "table" and self.rows is not None:
            self.close_block()
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self.b.table(rows)
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)

    def close_block(self) -> None:
        text, tag = " ".join("".join(self.text).split()), self.tag
        self.text, self.tag = [], None
        kind = self.BLOCKS.get(tag or "p", "paragraph")
        if kind == "cell" and self.rows is not None:
            self.rows and self.rows[-1].append(text)
        elif text:
            level = int(tag[1]) if kind == "heading" and tag else None
            self.b.add("title" if level == 1 and self.b.title is None else kind, text, level, self.lists[-1] if kind == "list_item" and self.lists else None)


def parse_html(content: bytes, b: Builder) -> None:
    p = _Html(b)
    p.feed(decoded(content))
    p.close()
    p.close_block()


def parse_rst(content: bytes, b: Builder) -> None:
    """Titles, bullet and numbered lists, literal blocks and paragraphs; directives that read or embed files are left out."""
    parts = re.split(r"\n\s*\n", decoded(content).replace("\r\n", "\n").strip("\n"))
    marks: list[str] = []
    literal = False
    for part in parts:
        lines = part.split("\n")
        title = re.match(r"^(?:([=\-~^\"'#*+])\1*\n)?(\S.*)\n([=\-~^\"'#*+])\3{2,}\s*$", part)
        item = re.match(r"^\s*(?:[-*+•]|\d+[.)])\s+", lines[0])
        if literal and all(x.startswith((" ", "\t")) or not x for x in lines):
            b.add("code", "\n".join(x.strip() for x in lines))
            literal = False
        elif title:
            if title[3] not in marks:
                marks.append(title[3])
            first = b.title is None and not b.blocks
            b.add("title" if first else "heading", title[2].strip(), 1 if first else max(1, marks.index(title[3])))
        elif lines[0].startswith(".. "):
            continue
        elif item:
            at = b.add("list", None)
            for x in re.split(r"\n(?=\s*(?:[-*+•]|\d+[.)])\s)", part):
                b.add("list_item", " ".join(re.sub(r"^\s*(?:[-*+•]|\d+[.)])\s+", "", x).split()), parent=at)
        else:
            text = " ".join(part.split())
            literal = text.endswith("::")
            if text.rstrip(":"):
                b.add("paragraph", text[:-1] if literal else text)


PARSERS = {"csv": parse_csv, "json": parse_json, "yaml": parse_yaml, "xml": parse_xml, "xlsx": parse_xlsx, "text": parse_text, "markdown": parse_markdown, "html": parse_html, "rst": parse_rst}


def parse(extension: str, content: bytes | None) -> dict[str, object]:
    """The first backend that succeeds; else the errors of all."""
    extension = (extension or "").lower().lstrip(".")
    errors = []
    for backend in ROUTES.get(extension, ()):
        b = Builder()
        try:
            if not content:
                raise Failure("INVALID_CONTENT", "empty")
            if backend == "source":
                b.add("code", decoded(content), language=LANGUAGES[extension])
            else:
                PARSERS[backend](content, b)
            return {"status": "success", "error": None, "backend": backend, "title": b.title, "blocks": b.blocks, "cells": b.cells}
        except Failure as e:
            errors.append(e.args[0])
        except RecursionError:
            errors.append("RESOURCE_LIMIT_EXCEEDED")
        except Exception:  # noqa: BLE001 a file may break its parser in any way
            errors.append("PARSING_FAILED")
    return {"status": "failed", "error": ",".join(errors) or "UNSUPPORTED_FORMAT", "backend": None, "title": None, "blocks": [], "cells": []}


def extract(files: DataFrame) -> DataFrame:
    """``files`` (file_id, extension, content) with the columns of DOCUMENT."""

    named = T.StructType([files.schema["file_id"], *T.StructType.fromDDL(DOCUMENT).fields])
    schema = to_arrow_schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict[str, object]] = []
            size = 0
            for i, x, c in zip(*(batch.column(k) for k in range(3))):
                content = c.as_py()
                rows.append({"file_id": i.as_py()} | parse(x.as_py(), content))
                size += len(content or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file_id", "extension", "content").mapInArrow(run, named)


def block_rows(documents: DataFrame) -> DataFrame:
    return documents.select("file_id", F.inline("blocks"))


def cell_rows(documents: DataFrame) -> DataFrame:
    return documents.select("file_id", F.inline("cells"))


# --- Quality and policy, over blocks (doc, ordinal, type, text, has_provenance, valid_table) -----------------


def quality(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The four scores and their mean by weights, of each document, rounded to three places."""
    text = F.trim(F.coalesce("text", F.lit("")))
    full = text != ""
    per = blocks.select(key, "type", full.alias("full"), F.length(text).alias("n"), (full & is_suspicious(text)).alias("odd"), "has_provenance", "valid_table", (full & (F.size(F.split(text, r"\s+")) >= 4) & (numeric_tokens(text) >= 2)).alias("table_like"))
    has = lambda *kinds: F.max(F.col("type").isin(*kinds).cast("int"))
    a = per.groupBy(key).agg(
        F.count("*").alias("blocks"), F.sum(F.col("full").cast("int")).alias("full"), F.sum("n").alias("chars"), F.sum(F.col("odd").cast("int")).alias("odd"), F.avg(F.col("has_provenance").cast("double")).alias("provenance"),
        has("heading", "title").alias("heads"), has("paragraph").alias("prose"), has("list", "list_item").alias("lists"), F.sum((F.col("type") == "table").cast("int")).alias("tables"), F.sum(((F.col("type") == "table") & F.col("valid_table")).cast("int")).alias("valid"),
        F.max(F.col("table_like").cast("int")).alias("table_like"),
    )
    content = F.when(F.col("chars") < 50, 0.4).when(F.col("chars") < 200, 0.7).otherwise(1.0)
    artifact = F.greatest(F.lit(0.0), 1 - F.least(2 * F.col("odd") / F.col("full"), F.lit(1.0)))
    a = a.select(
        key, "odd", "table_like",
        F.when(F.col("full") > 0, 0.4 * F.col("full") / F.col("blocks") + 0.4 * content + 0.2 * artifact).otherwise(0.0).alias("t"),
        F.least(F.lit(1.0), 0.35 * (F.col("blocks") >= 2).cast("int") + 0.30 * F.col("heads") + 0.20 * F.col("prose") + 0.15 * F.col("lists")).alias("s"),
        F.when(F.col("tables") > 0, F.col("valid") / F.col("tables")).otherwise(0.0).alias("b"), F.col("provenance").alias("p"),
    )
    return a.select(
        key, F.round("t", 3).alias("text_score"), F.round("s", 3).alias("structure_score"), F.round("b", 3).alias("table_score"), F.round("p", 3).alias("provenance_score"),
        F.round(0.5 * F.col("t") + 0.2 * F.col("s") + 0.1 * F.col("b") + 0.2 * F.col("p"), 3).alias("overall_score"), (F.col("odd") > 0).alias("suspicious"), (F.col("table_like") > 0).alias("table_like"),
    )


def warnings() -> Column:
    """Codes of what a quality row warns of, comma-joined."""
    return F.concat_ws(
        ",", F.when(F.col("text_score") < 0.70, "low_text"), F.when(F.col("structure_score") < 0.40, "little_structure"), F.when(F.col("table_like") & (F.col("table_score") == 0), "table_lost"),
        F.when(F.col("provenance_score") < 0.90, "provenance_missing"), F.when(F.col("suspicious"), "artifacts"),
    )


def reasons() -> Column:
    return F.concat_ws(",", F.when(F.col("text_score") < 0.75, "text"), F.when(F.col("provenance_score") < 0.80, "provenance"), F.when(F.col("overall_score") < 0.60, "overall"))


def policy() -> Column:
    return F.when(reasons() == "", "accept").otherwise("fallback")


# --- A second pass for what quality rejects ------------------------------------------------------------------

Backend = Callable[[DataFrame], DataFrame]


def routed(files: DataFrame, backends: Sequence[tuple[str, Backend]], key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Each file by the first backend whose blocks the policy accepts, else by the last: (attempts, blocks).

    ``backends`` are names and functions from files to blocks (key, ordinal, type, text, has_provenance, valid_table, further columns).
    Only files that the backend before had rejected, or had no block for, reach the next one. The blocks of a pass are written once, to the
    checkpoint folder, so no backend runs twice; a pass that has no file left runs over none.

    Of a file: backend (null if it has no blocks), status (accepted, fallback or failed), warnings of the blocks taken, and attempts, an
    array of (backend, decision, reasons, warnings, overall_score) in order; a pass without blocks has the decision ``failed`` and nothing else.
    Files whose key is null take no part; files that share a key are handed on together and count as one.
    """
    parts = ("backend", "decision", "reasons", "warnings", "overall_score")
    shared_folder(files.sparkSession)
    left = files.where(F.col(key).isNotNull())
    passes, taken = [], []
    for i, (name, backend) in enumerate(backends):
        made = backend(left).checkpoint()
        scored = quality(made, key).select(key, policy().alias("decision"), reasons().alias("reasons"), warnings().alias("warnings"), "overall_score")
        tried = left.select(key).distinct().join(scored, key, "left")
        tried = tried.select(key, F.lit(i).alias("_pass"), F.lit(name).alias("backend"), F.coalesce("decision", F.lit("failed")).alias("decision"), "reasons", "warnings", "overall_score").checkpoint()
        passes.append(tried)
        good = tried.where("decision = 'accept'") if i + 1 < len(backends) else tried
        taken.append(made.join(good.select(key), key, "left_semi").withColumn("backend", F.lit(name)))
        left = left.join(tried.where("decision <> 'accept'").select(key), key, "left_semi")
    rows = reduce(DataFrame.unionByName, passes)
    # As many entries as backends.
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pass", *parts))).alias("all"))
    last = F.element_at("all", -1)
    attempts = held.select(
        key, F.when(last["decision"] != "failed", last["backend"]).alias("backend"), F.when(last["decision"] == "accept", "accepted").otherwise(last["decision"]).alias("status"), last["warnings"].alias("warnings"),
        F.transform("all", lambda a: F.struct(*[a[c].alias(c) for c in parts])).alias("attempts"),
    )
    return attempts, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), taken)


# --- Structure over blocks -----------------------------------------------------------------------------------


def heading_levels(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds level: place of the font size among the document's distinct sizes from the largest; null for the smallest."""
    sizes = Window.partitionBy(key).orderBy(F.desc("font_size"))
    least = F.min("font_size").over(Window.partitionBy(key))
    return blocks.withColumn("level", F.when(F.col("font_size") > least, F.dense_rank().over(sizes)))


def first_title(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, title): the first title, else the first heading of level 1."""
    rank = F.when(F.col("type") == "title", 0).when((F.col("type") == "heading") & (F.col("level") == 1), 1)
    return blocks.withColumn("_r", rank).where("_r is not null").groupBy(key).agg(F.min_by("text", F.struct("_r", "ordinal")).alias("title"))


def page_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, page, blocks in order)"""
    return blocks.where("page_number is not null").groupBy(key, "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list("ordinal")), lambda x: x.cast("string")), ",").alias("block_ids"))


def without_table_parts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks whose parent and grandparent are no table. ``blocks`` has ordinal, parent and type."""
    b = blocks.select(F.col(key).alias("_k"), F.col("ordinal").alias("_o"), F.col("parent").alias("_up"), (F.col("type") == "table").alias("_t"))
    p, g = b.select(*[F.col(c).alias(f"p{c}") for c in b.columns]), b.select(*[F.col(c).alias(f"g{c}") for c in b.columns])
    out = blocks.join(p, (F.col(key) == F.col("p_k")) & (F.col("parent") == F.col("p_o")), "left").join(g, (F.col(key) == F.col("g_k")) & (F.col("p_up") == F.col("g_o")), "left")
    return out.where(~F.coalesce("p_t", F.lit(False)) & ~F.coalesce("g_t", F.lit(False))).select(*blocks.columns)


def block_counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    kinds = ["title", "heading", "paragraph", "list_item", "table"]
    return blocks.groupBy(key).pivot("type", kinds).count().select(key, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


def within_limits(rows: Column, columns: Column) -> Column:
    return (rows <= MAX_ROWS) & (columns <= MAX_COLUMNS) & (rows * columns <= MAX_CELLS)
