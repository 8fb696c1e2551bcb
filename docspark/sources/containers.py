"""Office files, e-books, archives, rich text, drawings and data files: contents as rows of lines.

Readers take bytes (from ``binaryFile``) and run in Arrow batches; ``READERS`` is the
registry by extension. A file that can't be read gives one row of kind ``error``.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pieces import pieces
from ..registry import query
from ..sinks.exporters import WRITERS
from .tables import Tables

#: Bounds on what an archive may unpack to: members, bytes, and bytes for each packed byte.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 200 << 20, 200

Rows = list[tuple[str, str]]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _members(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_BYTES or any(i.file_size > MOST_RATIO * max(i.compress_size, 100) for i in infos):
        raise ValueError("the archive unpacks to too much")
    return z


def _texts(xml: bytes, block: str, leaf: str) -> list[str]:
    """The joined leaf texts of each block element."""
    return ["".join(x.text or "" for x in b.iter() if _local(x.tag) == leaf) for b in ElementTree.fromstring(xml).iter() if _local(b.tag) == block]


def _named(node, tag: str):
    """Elements below a node with this local name, in document order."""
    return (x for x in node.iter() if _local(x.tag) == tag)


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _run_text(node, leaf: str = "t") -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(x.text or "" if _local(x.tag) == leaf else marks.get(_local(x.tag), "") for x in node.iter())


def _grid(table, row: str, cell: str, text: Callable) -> Rows:
    return [("table_row", "\t".join(text(c) for c in r if _local(c.tag) == cell)) for r in table if _local(r.tag) == row]


def _docx_blocks(parent) -> Rows:
    rows: Rows = []
    for block in parent:
        kind = _local(block.tag)
        if kind == "p":
            style = next((_attribute(s, "val") or "" for s in _named(block, "pStyle")), "")
            level = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            listed = next(_named(block, "numPr"), None) is not None
            rows.append((f"heading{level[1]}" if level else "title" if style.lower() == "title" else "list_item" if listed else "paragraph", _run_text(block)))
        elif kind == "tbl":
            rows += _grid(block, "tr", "tc", lambda c: "\n".join(body for _, body in _docx_blocks(c)))
        elif kind in ("sdt", "sdtContent"):
            rows += _docx_blocks(block)
    return rows


def docx(data: bytes) -> Rows:
    """Headings by style, list items, paragraphs, and tables as rows of cells; then foot- and endnotes."""
    z = _members(data)
    rows = _docx_blocks(next(_named(ElementTree.fromstring(z.read("word/document.xml")), "body")))
    for name in ("word/footnotes.xml", "word/endnotes.xml"):
        if name in z.namelist():
            notes = (n for n in ElementTree.fromstring(z.read(name)) if not _attribute(n, "type"))
            rows += [("note", "\n".join(_run_text(p) for p in _named(n, "p"))) for n in notes]
    return rows


def _numbered_parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def pptx(data: bytes) -> Rows:
    """Slide by slide: titles, paragraphs and table rows; then the slide's notes."""
    z = _members(data)
    rows: Rows = []
    for name in _numbered_parts(z, r"ppt/slides/slide\d+\.xml"):
        root = ElementTree.fromstring(z.read(name))
        tables = list(_named(root, "tbl"))
        titles = {id(p) for shape in _named(root, "sp") if any((_attribute(h, "type") or "") in ("title", "ctrTitle") for h in _named(shape, "ph")) for p in _named(shape, "p")}
        inside = {id(p) for t in tables for p in _named(t, "p")}
        for node in root.iter():
            if _local(node.tag) == "tbl":
                rows += _grid(node, "tr", "tc", lambda c: "\n".join(_run_text(p) for p in _named(c, "p")))
            elif _local(node.tag) == "p" and id(node) not in inside:
                rows.append(("heading1" if id(node) in titles else "paragraph", _run_text(node)))
        notes = name.replace("slides/slide", "notesSlides/notesSlide")
        if notes in z.namelist():
            rows += [("note", x) for p in _named(ElementTree.fromstring(z.read(notes)), "p") if (x := _run_text(p)).strip()]
    return rows


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list[tuple[str | None, str]]:
    """(name, part) of the sheets, in the workbook's order where it has one."""
    parts = _numbered_parts(z, r"xl/worksheets/sheet\d+\.xml")
    links = "xl/_rels/workbook.xml.rels"
    if "xl/workbook.xml" not in z.namelist() or links not in z.namelist():
        return [(None, p) for p in parts]
    target = {_attribute(r, "Id"): _attribute(r, "Target").removeprefix("/xl/") for r in ElementTree.fromstring(z.read(links))}
    return [(s.get("name"), f"xl/{target[_attribute(s, 'id')]}") for s in _named(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]


def xlsx(data: bytes) -> Rows:
    """Sheet by sheet, each under its name: rows of cells at their columns; a merged range repeats its first cell."""
    z = _members(data)
    shared = _texts(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in z.namelist() else []
    rows: Rows = []
    for title, part in _sheets(z):
        if title is not None:
            rows.append(("heading1", title))
        root = ElementTree.fromstring(z.read(part))
        grid: dict[int, dict[int, str]] = {}
        for i, row in enumerate(_named(root, "row"), 1):
            cells = grid.setdefault(int(row.get("r") or i), {})
            for j, c in enumerate(x for x in row if _local(x.tag) == "c"):
                value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                kind = c.get("t")
                cells[_column(c.get("r")) if c.get("r") else j] = shared[int(value)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
        for merged in _named(root, "mergeCell"):
            first, _, last = merged.get("ref").partition(":")
            (r0, c0), (r1, c1) = ((int(re.search(r"\d+", x)[0]), _column(x)) for x in (first, last or first))
            if (r1 - r0 + 1) * (c1 - c0 + 1) <= 10_000:
                value = grid.get(r0, {}).get(c0, "")
                for r in range(r0, r1 + 1):
                    grid.setdefault(r, {}).update(dict.fromkeys(range(c0, c1 + 1), value))
        rows += [("table_row", "\t".join(cells.get(j, "") for j in range(max(cells) + 1))) for _, cells in sorted(grid.items()) if cells]
    return rows


def odt(data: bytes) -> Rows:
    root = ElementTree.fromstring(_members(data).read("content.xml"))
    return [("heading" if _local(x.tag) == "h" else "paragraph", "".join(x.itertext())) for x in root.iter() if _local(x.tag) in ("p", "h")]


def _spine(z: zipfile.ZipFile) -> list[str]:
    """The chapters in reading order; all pages by name where the package doesn't say."""
    pages = sorted(n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm")))
    if "META-INF/container.xml" not in z.namelist():
        return pages
    package = next(x.get("full-path") for x in _named(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile"))
    root = ElementTree.fromstring(z.read(package))
    base = package.rpartition("/")[0]
    paths = {i.get("id"): f"{base}/{i.get('href')}".lstrip("/") for i in _named(root, "item")}
    return [paths[r.get("idref")] for r in _named(root, "itemref") if paths.get(r.get("idref")) in z.namelist()]


def epub(data: bytes) -> Rows:
    from ..operators.documents import html_elements

    z = _members(data)
    return [(kind, body) for n in _spine(z) for kind, _, body in html_elements(z.read(n).decode("utf-8", "replace"))]


def archive(data: bytes) -> Rows:
    z = _members(data)
    return [("member", z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist())]


def tar(data: bytes) -> Rows:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        members = sorted((m for m in t.getmembers() if m.isfile()), key=lambda m: m.name)
        if len(members) > MOST_MEMBERS or sum(m.size for m in members) > MOST_BYTES:
            raise ValueError("the archive unpacks to too much")
        return [("member", t.extractfile(m).read().decode("utf-8", "replace")) for m in members]


def rtf(data: bytes) -> Rows:
    """Paragraphs of rich text: control words dropped, escapes and code units decoded."""
    body = re.sub(r"\\([\\{}])", lambda m: f"\\'{ord(m[1]):02x}", data.decode("latin-1"))
    body = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", body)
    body = re.sub(r"(?:\\u-?\d+\??)+", lambda m: b"".join((int(n) % 65536).to_bytes(2, "little") for n in re.findall(r"\\u(-?\d+)", m[0])).decode("utf-16-le", "replace"), body)
    body = re.sub(r"\\par[d]?\b ?", "\n", body)
    body = re.sub(r"\\[a-z]+-?\d* ?|[{}\r]", "", body)
    body = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), body)
    paragraphs = body.split("\n")  # each is ended; what follows the last end is one only if there is something
    return [("paragraph", x) for x in (paragraphs if paragraphs[-1] else paragraphs[:-1])]


def svg(data: bytes) -> Rows:
    names = [_local(x.tag) for x in ElementTree.fromstring(data).iter()]
    return [("count", f"{n} {names.count(n)}") for n in sorted(set(names))]


def xml(data: bytes) -> Rows:
    """Texts by the path of their element."""
    out: Rows = []

    def walk(node, path):
        path = f"{path}/{_local(node.tag)}"
        if (node.text or "").strip():
            out.append((path, node.text.strip()))
        for child in node:
            walk(child, path)

    walk(ElementTree.fromstring(data), "")
    return out


def outline(value) -> Rows:
    """Leaves by path; of a long list the first five and the last two."""
    out: Rows = []

    def walk(x, path, depth):
        if depth > 20:
            out.append((path, "..."))
        elif isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}", depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x[:5] + x[-2:] if len(x) > 7 else x):
                walk(v, f"{path}[{i}]", depth + 1)
        else:
            out.append((path, json.dumps(x, ensure_ascii=False, default=str)))

    walk(value, "$", 0)
    return out


def json_outline(data: bytes) -> Rows:
    return outline(json.loads(data))


def yaml_outline(data: bytes) -> Rows:
    """The same for each YAML document of a file; needs the yaml package."""
    import yaml

    found = list(yaml.safe_load_all(data.decode("utf-8", "replace")))
    return [row for doc in found for row in outline(doc)]


def project(data: bytes) -> Rows:
    """Media paths, sequences and bins of a gzipped XML editing project, in the file's order."""
    root = ElementTree.fromstring(gzip.decompress(data))
    name = lambda x: next((n.text or "" for n in x if _local(n.tag) == "Name"), "")
    kinds = {"Sequence": "sequence", "BinProjectItem": "bin"}
    rows: Rows = []
    for x in root.iter():
        kind = _local(x.tag)
        if kind in ("FilePath", "ActualMediaFilePath") and x.text:
            rows.append(("media", x.text))
        elif kind in kinds and name(x):
            rows.append((kinds[kind], name(x)))
    return list(dict.fromkeys(rows))


READERS: dict[str, Callable[[bytes], Rows]] = {
    "docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odt, "ods": odt, "odp": odt, "epub": epub, "zip": archive, "tar": tar, "tar.gz": tar, "rtf": rtf, "svg": svg, "xml": xml, "json": json_outline, "yaml": yaml_outline, "yml": yaml_outline, "prproj": project,
}


def read(files: DataFrame, id_: str, kind: str, content: str = "content") -> DataFrame:
    """(id, pos, kind, body) of all lines of the files' contents by the reader of ``kind``."""
    reader = READERS[kind]

    def rows_of(data) -> Rows:
        try:
            return reader(bytes(data))
        except Exception as e:  # a broken file is a row, not a failed job
            return [("error", type(e).__name__)]

    def run(batches):
        for pdf in batches:
            rows = ((i, pos, k, body) for i, data in zip(pdf[id_], pdf[content]) if data is not None for pos, (k, body) in enumerate(rows_of(data)))
            yield from pieces(rows, [id_, "pos", "kind", "body"])

    return files.select(id_, content).mapInPandas(run, f"{id_} bigint, pos int, kind string, body string")


def write(lines: DataFrame, id_: str, column: str, kind: str) -> DataFrame:
    """(id, content): each array of lines as a file of that kind; null makes none."""
    writer = WRITERS[kind]

    def run(batches):
        for pdf in batches:
            yield from pieces(((i, writer(list(x))) for i, x in zip(pdf[id_], pdf[column]) if x is not None), [id_, "content"])

    return lines.select(id_, column).mapInPandas(run, f"{id_} bigint, content binary")


def _lines(t: Tables) -> DataFrame:
    """Lines of all texts but those of spaces alone, of any width. XML has no place for control characters; they go as U+FFFD."""
    clean = F.regexp_replace("content", r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", "\ufffd")
    return t.corpus.select("id", F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\p{Zs}]")).alias("lines"))


_LINES_SQL = "SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY i)-1 AS INT) AS pos, body FROM (SELECT id, UNNEST(RANGE(LEN(l))) AS i, UNNEST(l) AS body FROM (SELECT id, STRING_SPLIT(REGEXP_REPLACE(content,'[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]',CHR(65533),'g'),CHR(10)) AS l FROM v_corpus)) WHERE TRIM(body) <> ''"


def _round_trip(kind: str):
    return lambda t: read(write(_lines(t), "id", "lines", kind), "id", kind).select("id", "pos", "body")


for _id, _kind in (("S22_archive", "zip"), ("S24_docx", "docx"), ("S26_pptx", "pptx"), ("S27_xlsx", "xlsx"), ("S28_odt", "odt"), ("S29_rtf", "rtf")):
    query(f"{_id}_round_trip", _LINES_SQL)(_round_trip(_kind))


@query("S30_epub")
def epub_lines(t: Tables) -> DataFrame:
    return read(write(_lines(t), "id", "lines", "epub"), "id", "epub")


@query("S12b_json_outline", "SELECT id, 0 AS pos, '$.k' AS kind, metadata->>'$.k' AS body FROM v_activity_events")
def json_outlines(t: Tables) -> DataFrame:
    return read(t.activity_events.select("id", F.col("metadata").cast("binary").alias("content")), "id", "json")


@query("S13_yaml_outline", "SELECT id, 0 AS pos, '$.lang' AS kind, '\"'||lang||'\"' AS body FROM v_corpus UNION ALL SELECT id, 1, '$.meta.source', '\"'||source_format||'\"' FROM v_corpus UNION ALL SELECT id, 2, '$.meta.size', CAST(file_size_bytes AS VARCHAR) FROM v_corpus UNION ALL SELECT id, 3, '$.tags[0]', '\"a\"' FROM v_corpus")
def yaml_outlines(t: Tables) -> DataFrame:
    text = F.concat(F.lit("lang: '"), F.col("lang"), F.lit("'\nmeta:\n  source: "), F.col("source_format"), F.lit("\n  size: "), F.col("file_size_bytes").cast("string"), F.lit("\ntags:\n- a\n"))
    return read(t.corpus.select("id", text.cast("binary").alias("content")), "id", "yaml")


@query("S34_project_edges", "SELECT project_id, media_path FROM (SELECT DISTINCT project_id, media_path FROM v_media_refs) UNION ALL SELECT DISTINCT project_id, 'cut '||project_id FROM v_media_refs")
def project_edges(t: Tables) -> DataFrame:
    """Editing projects written as files, and the media and sequences read out of them."""
    own = t.media_refs.groupBy("project_id").agg(F.array_sort(F.collect_set("media_path")).alias("lines"))
    own = own.withColumn("lines", F.concat(F.array(F.concat(F.lit("cut "), F.col("project_id").cast("string"))), "lines"))
    return read(write(own, "project_id", "lines", "prproj"), "project_id", "prproj").select("project_id", F.col("body").alias("media_path"))


@query("S15_xml_paths", "SELECT id, 0 AS pos, '/doc/lang' AS kind, lang AS body FROM v_corpus UNION ALL SELECT id, 1, '/doc/meta/source', source_format FROM v_corpus")
def xml_paths(t: Tables) -> DataFrame:
    body = F.concat(F.lit("<doc><lang>"), F.col("lang"), F.lit("</lang><meta><source>"), F.col("source_format"), F.lit("</source></meta></doc>"))
    return read(t.corpus.select("id", body.cast("binary").alias("content")), "id", "xml")


@query("S31_svg", "SELECT id, 0 AS pos, 'count' AS kind, 'circle 1' AS body FROM v_corpus UNION ALL SELECT id, 1, 'count', 'rect '||(MOD(LENGTH(content),5)+1) FROM v_corpus UNION ALL SELECT id, 2, 'count', 'svg 1' FROM v_corpus")
def svg_counts(t: Tables) -> DataFrame:
    drawing = F.concat(F.lit('<svg xmlns="s"><circle/>'), F.repeat(F.lit("<rect/>"), (F.length("content") % 5 + 1).cast("int")), F.lit("</svg>"))
    return read(t.corpus.select("id", drawing.cast("binary").alias("content")), "id", "svg")


@query("S33_sniffed_type", "SELECT id, CASE MOD(LENGTH(content),4) WHEN 0 THEN 'application/zip' WHEN 1 THEN 'text/rtf' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM v_corpus")
def sniffed(t: Tables) -> DataFrame:
    from ..functions.text import mime_of

    kind = F.length("content") % 4
    first = F.when(kind == 0, F.lit(b"PK\x03\x04")).when(kind == 1, F.lit(b"{\\rtf1 ")).when(kind == 2, F.lit(b"%PDF-")).otherwise(F.lit(b"\x00"))
    content = F.concat(first, F.col("content").cast("binary"))
    return t.corpus.select("id", mime_of(content, {b"PK\x03\x04": "application/zip", b"{\\rtf": "text/rtf", b"%PDF": "application/pdf"}, "application/octet-stream").alias("mime"))
