"""Documents as elements: parsing plain text, HTML, Markdown, captions; chunks, diffs, renderers."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.pieces import pieces
from ..registry import query
from ..sources.tables import Tables
from . import line_diff
from .windows import numbered_within


@query("S18_text_elements", """WITH p AS (SELECT id, CAST(UNNEST(RANGE(LEN(STRING_SPLIT(content,CHR(10))))) AS INT) AS pos, UNNEST(STRING_SPLIT(content,CHR(10))) AS body FROM v_corpus)
SELECT id, pos, CASE WHEN LENGTH(body) <= 80 AND UPPER(body) = body AND REGEXP_MATCHES(body,'[A-Z]') THEN 'heading' ELSE 'paragraph' END AS kind, body FROM p WHERE TRIM(body) <> ''""")
def text_elements(t: Tables) -> DataFrame:
    """Lines of plain text as paragraphs, short capital ones as headings."""
    rows = t.corpus.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "body")).filter(F.trim("body") != "")
    head = (F.length("body") <= 80) & (F.upper("body") == F.col("body")) & F.col("body").rlike("[A-Z]")
    return rows.select("id", "pos", F.when(head, "heading").otherwise("paragraph").alias("kind"), "body")


_BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "pre": "code_block", "blockquote": "blockquote", "td": "cell", "th": "cell", "title": "title"}


@query("S18b_setext_headings", """WITH l AS (SELECT id, UNNEST(RANGE(LEN(w))) AS pos, UNNEST(w) AS body FROM (SELECT id, STRING_SPLIT(REPLACE(title,CHR(10),' ')||CHR(10)||'====='||CHR(10)||content||CHR(10)||lang||CHR(10)||'-----',CHR(10)) AS w FROM v_corpus)),
n AS (SELECT *, LEAD(body) OVER (PARTITION BY id ORDER BY pos) AS below FROM l) SELECT id, pos::INT AS pos, CASE WHEN REGEXP_MATCHES(below,'^=+[ ]*$') THEN 1 ELSE 2 END AS level, TRIM(body) AS heading FROM n WHERE TRIM(body) <> '' AND REGEXP_MATCHES(below,'^(=+|-{2,})[ ]*$') AND NOT REGEXP_MATCHES(body,'^(=+|-{2,})[ ]*$')""")
def setext_headings(t: Tables) -> DataFrame:
    """Lines that a line of equals signs (first level) or hyphens (second) underlines."""
    flat = F.replace(F.col("title"), F.lit("\n"), F.lit(" "))
    text = F.concat(flat, F.lit("\n=====\n"), F.col("content"), F.lit("\n"), F.col("lang"), F.lit("\n-----"))
    lines = F.split(text, "\n")
    pairs = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("body"), F.get(lines, i + 1).alias("below")))
    under = r"^(=+|-{2,})[ ]*$"
    found = F.filter(pairs, lambda p: (F.trim(p["body"]) != "") & F.coalesce(p["below"].rlike(under), F.lit(False)) & ~p["body"].rlike(under))
    rows = t.corpus.select("id", F.explode(found).alias("p"))
    return rows.select("id", "p.pos", F.when(F.col("p.below").startswith("="), 1).otherwise(2).alias("level"), F.trim("p.body").alias("heading"))


class _Elements(HTMLParser):
    """Text of block elements in order; text outside any block is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.kind, self.level, self.held, self.skip = [], "paragraph", 0, [], 0

    def flush(self):
        body = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if body:
            self.rows.append((self.kind, self.level, body))
        self.held, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in _BLOCKS:
            self.flush()
            self.kind, self.level = _BLOCKS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
        elif tag in ("hr", "img", "br"):
            if tag != "br":
                self.flush()
                self.rows.append(("image" if tag == "img" else "hr", 0, dict(attrs).get("alt") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS or tag in ("div", "section", "table", "ul", "ol"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_elements(html: str) -> list[tuple[str, int, str]]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.rows


def _exploded(df: DataFrame, id_: str, column: str, parse) -> DataFrame:
    """(id, pos, kind, level, body) of all elements, parsed in Arrow batches."""

    def run(batches):
        for pdf in batches:
            rows = ((i, pos, *e) for i, body in zip(pdf[id_], pdf[column]) for pos, e in enumerate(parse(body)))
            yield from pieces(rows, [id_, "pos", "kind", "level", "body"])

    return df.select(id_, column).mapInPandas(run, f"{id_} bigint, pos int, kind string, level int, body string")


@query("S16_html_elements")
def pages_as_elements(t: Tables) -> DataFrame:
    return _exploded(t.raw("pages"), "page_id", "html", html_elements)


def lines(text: str) -> Iterator[str]:
    """What split gives, one by one."""
    start = 0
    while (stop := text.find("\n", start)) >= 0:
        yield text[start:stop]
        start = stop + 1
    yield text[start:]


def markdown_blocks(markdown: str) -> Iterator[tuple[str, int, str]]:
    """Blocks of Markdown as they end: headings, fences, quotes, list items, table rows, rules, paragraphs."""
    held: list[str] = []
    fence = None

    def flush():
        if held:
            yield "paragraph", 0, " ".join(held)
            held.clear()

    code: list[str] = []
    for line in lines(markdown or ""):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                yield "code_block", 0, "\n".join(code)
                fence = None
            else:
                code.append(line)
        elif bare[:3] in ("```", "~~~"):
            yield from flush()
            fence, code = bare[:3], []
        elif not bare:
            yield from flush()
        elif m := re.match(r"(#{1,6})\s+(.*)", bare):
            yield from flush()
            yield "heading", len(m[1]), m[2].rstrip("# ")
        elif re.fullmatch(r"([-*_])(\s*\1){2,}", bare):
            yield from flush()
            yield "hr", 0, ""
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", bare):
            yield from flush()
            yield "list_item", (len(line) - len(line.lstrip())) // 2, m[1]
        elif bare[0] == ">":
            yield from flush()
            yield "blockquote", 0, bare.lstrip("> ")
        elif bare[0] == "|":
            yield from flush()
            if not re.fullmatch(r"[|:\- ]+", bare):
                yield "table_row", 0, bare.strip("|")
        else:
            held.append(bare)
    yield from flush()
    if fence:
        yield "code_block", 0, "\n".join(code)


def markdown_elements(markdown: str) -> list[tuple[str, int, str]]:
    return list(markdown_blocks(markdown))


def _markdown(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n\n- one\n- two\n\n> said\n")).alias("markdown"))


@query("S17_markdown_elements")
def corpus_as_elements(t: Tables) -> DataFrame:
    return _exploded(_markdown(t), "id", "markdown", markdown_blocks)


def captions_of(segments: DataFrame) -> DataFrame:
    """(history_id, srt): the caption file of each transcript. A blank line would end a caption, so those in a text hold a no-break space."""
    text = F.regexp_replace(F.regexp_replace("text", r"\A(?=\n)", "\u00a0"), r"\n(?=\n|\z)", "\n\u00a0")
    line = F.concat_ws("\n", (F.col("segment_index") + 1).cast("string"), F.concat(X.caption_time(F.col("start_seconds"), ","), F.lit(" --> "), X.caption_time(F.col("end_seconds"), ",")), text)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", line.alias("line")))), lambda s: s.line)
    return segments.groupBy("history_id").agg(F.array_join(parts, "\n\n").alias("srt"))


def parsed_captions(files: DataFrame) -> DataFrame:
    """Segments of caption files (SRT or VTT): one for each block with a time line."""
    block = files.select("history_id", F.posexplode(F.split("srt", r"\n\n(?=\d+\n)")).alias("pos", "block"))
    time = r"((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n([\s\S]*)"
    part = lambda n: F.regexp_extract("block", time, n)
    text = F.regexp_replace(F.regexp_replace(part(3), "\n\u00a0", "\n"), "\\A\u00a0(?=\n)", "")
    return block.filter(F.col("block").rlike("-->")).select("history_id", F.col("pos").cast("long").alias("segment_index"), X.seconds_of(part(1)).alias("start_seconds"), X.seconds_of(part(2)).alias("end_seconds"), text.alias("text"))


@query("S20_caption_round_trip", "SELECT history_id, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY segment_index)-1 AS segment_index, start_seconds, end_seconds, text FROM v_transcript_segments")
def caption_round_trip(t: Tables) -> DataFrame:
    return parsed_captions(captions_of(t.transcript_segments))


@query("K14_transcript_markdown", "SELECT history_id, STRING_AGG('**'||speaker||':** '||text, CHR(10)||CHR(10) ORDER BY segment_index) AS markdown FROM v_transcript_segments GROUP BY 1")
def transcript_markdown(t: Tables) -> DataFrame:
    line = F.concat(F.lit("**"), F.col("speaker"), F.lit(":** "), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", line.alias("line")))), lambda s: s.line)
    return t.transcript_segments.groupBy("history_id").agg(F.array_join(parts, "\n\n").alias("markdown"))


def captions(segments: DataFrame, mark: str, numbered: bool, head: str) -> DataFrame:
    """(history_id, captions): segments in order as blocks of their times and text, with what stands between seconds and milliseconds, numbers and a first line of a caption format."""
    times = F.concat(X.caption_time(F.col("start_seconds"), mark), F.lit(" --> "), X.caption_time(F.col("end_seconds"), mark), F.lit("\n"), F.col("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", times.alias("block")))), lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), s["block"]) if numbered else s["block"])
    return segments.groupBy("history_id").agg(F.concat(F.lit(head), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("captions"))


@query("K14b_transcript_srt", """SELECT history_id, STRING_AGG(rn||CHR(10)||LPAD((start_seconds::BIGINT//3600)::INT::VARCHAR,2,'0')||':'||LPAD(((start_seconds::BIGINT%3600)//60)::INT::VARCHAR,2,'0')||':'||LPAD((start_seconds::BIGINT%60)::INT::VARCHAR,2,'0')||',000'||' --> '||LPAD((end_seconds::BIGINT//3600)::INT::VARCHAR,2,'0')||':'||LPAD(((end_seconds::BIGINT%3600)//60)::INT::VARCHAR,2,'0')||':'||LPAD((end_seconds::BIGINT%60)::INT::VARCHAR,2,'0')||',000'||CHR(10)||text, CHR(10)||CHR(10) ORDER BY segment_index)||CHR(10) AS captions FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY segment_index) AS rn FROM v_transcript_segments) GROUP BY 1""")
def transcript_srt(t: Tables) -> DataFrame:
    return captions(t.transcript_segments, ",", True, "")


@query("K14c_transcript_vtt", """SELECT history_id, 'WEBVTT'||CHR(10)||CHR(10)||STRING_AGG(LPAD((start_seconds::BIGINT//3600)::INT::VARCHAR,2,'0')||':'||LPAD(((start_seconds::BIGINT%3600)//60)::INT::VARCHAR,2,'0')||':'||LPAD((start_seconds::BIGINT%60)::INT::VARCHAR,2,'0')||'.000'||' --> '||LPAD((end_seconds::BIGINT//3600)::INT::VARCHAR,2,'0')||':'||LPAD(((end_seconds::BIGINT%3600)//60)::INT::VARCHAR,2,'0')||':'||LPAD((end_seconds::BIGINT%60)::INT::VARCHAR,2,'0')||'.000'||CHR(10)||text, CHR(10)||CHR(10) ORDER BY segment_index)||CHR(10) AS captions FROM v_transcript_segments GROUP BY 1""")
def transcript_vtt(t: Tables) -> DataFrame:
    return captions(t.transcript_segments, ".", False, "WEBVTT\n\n")


def rendered(kind: Column, level: Column, body: Column) -> Column:
    """An element as Markdown."""
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), body)).when(kind == "list_item", F.concat(F.lit("- "), body)).when(kind == "blockquote", F.concat(F.lit("> "), body)).when(kind == "code_block", F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(kind == "hr", F.lit("---")).otherwise(body)


@query("K08_render_markdown")
def render_markdown(t: Tables) -> DataFrame:
    elements = _exploded(t.raw("pages"), "page_id", "html", html_elements)
    line = rendered(F.col("kind"), F.col("level"), F.col("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s.line)
    return elements.groupBy("page_id").agg(F.array_join(parts, "\n\n").alias("markdown"))


@query("D03_document_round_trip")
def document_round_trip(t: Tables) -> DataFrame:
    """Pages parsed, rendered as Markdown and parsed again: elements of the first and of the second reading by kind."""
    first = _exploded(t.raw("pages"), "page_id", "html", html_elements)
    again = _exploded(render_markdown(t), "page_id", "markdown", markdown_blocks)
    counts = lambda df, name: df.groupBy("page_id", "kind").agg(F.count("*").alias(name))
    return counts(first, "parsed").join(counts(again, "reparsed"), ["page_id", "kind"], "full_outer").fillna(0, ["parsed", "reparsed"])


@query("K09_frontmatter_writer", "SELECT id, '---'||CHR(10)||'source: '||source_format||CHR(10)||'lang: '||lang||CHR(10)||'---'||CHR(10)||title AS markdown FROM v_corpus")
def frontmatter_writer(t: Tables) -> DataFrame:
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    return t.corpus.select("id", F.concat_ws("\n", F.lit("---"), field("source", "source_format"), field("lang", "lang"), F.lit("---"), "title").alias("markdown"))


@query("K11_text_writer")
def text_writer(t: Tables) -> DataFrame:
    """Without an oracle: the engines' upper cases differ outside ASCII."""
    return t.corpus.select("id", F.concat_ws("\n", F.upper("title"), F.repeat(F.lit("-"), 40), "content").alias("plain"))


@query("K12_html_writer", "SELECT id, '<h1>'||REPLACE(REPLACE(REPLACE(title,'&','&amp;'),'<','&lt;'),'>','&gt;')||'</h1>' AS html FROM v_corpus")
def html_writer(t: Tables) -> DataFrame:
    escaped = F.col("title")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return t.corpus.select("id", F.concat(F.lit("<h1>"), escaped, F.lit("</h1>")).alias("html"))


def escaped(x: Column) -> Column:
    """Text as it stands in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


_ESCAPED = "REPLACE(REPLACE(REPLACE({},'&','&amp;'),'<','&lt;'),'>','&gt;')"


@query("K12b_html_document", f"""WITH l AS (SELECT id, UNNEST(RANGE(LEN(w))) AS pos, UNNEST(w) AS body FROM (SELECT id, STRING_SPLIT(content,CHR(10)) AS w FROM v_corpus)),
k AS (SELECT id, pos, CASE WHEN LENGTH(body) <= 80 AND UPPER(body) = body AND REGEXP_MATCHES(body,'[A-Z]') THEN '<h2>'||{_ESCAPED.format('body')}||'</h2>' ELSE '<p>'||{_ESCAPED.format('body')}||'</p>' END AS line FROM l WHERE TRIM(body) <> '')
SELECT c.id, '<html><head><title>'||{_ESCAPED.format('ANY_VALUE(title)')}||'</title></head><body>'||CHR(10)||COALESCE(STRING_AGG(line, CHR(10) ORDER BY pos)||CHR(10),'')||'</body></html>' AS html FROM v_corpus c LEFT JOIN k ON k.id = c.id GROUP BY c.id""")
def html_document(t: Tables) -> DataFrame:
    """A whole page of each document: its title, its lines as paragraphs, short capital ones as headings."""
    def line(x: Column) -> Column:
        head = (F.length(x) <= 80) & (F.upper(x) == x) & x.rlike("[A-Z]")
        return F.when(head, F.concat(F.lit("<h2>"), escaped(x), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), escaped(x), F.lit("</p>")))

    lines = F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(line(x), F.lit("\n")))
    page = F.concat(F.lit("<html><head><title>"), escaped(F.col("title")), F.lit("</title></head><body>\n"), F.array_join(lines, ""), F.lit("</body></html>"))
    return t.corpus.select("id", page.alias("html"))


# Sizes of chunks in characters, and the separators to cut at, best first.
LARGE, SMALL, OVERLAP = 1600, 200, 200
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ")
# What opens a section, and what stands before the text.
HEADING = re.compile(r"(?m)^(#{1,3})\s+(.+)$")
FRONT_MATTER = re.compile(r"(?s)\A---\s*\n.*?\n(?:---|\.\.\.)[ \t]*\n?")


class CutPlaces:
    """Where a text may be cut: the ends of all separators, found in one pass for each kind and looked up by bisection."""

    def __init__(self, body: str):
        self.ends = [[m.start() + len(s) for m in re.finditer(f"(?={re.escape(s)})", body)] for s in SEPARATORS]

    def last(self, lo: int, hi: int) -> int:
        """The end of the last separator of the best kind that starts at lo or later and ends at hi or before; hi without any."""
        for ends, s in zip(self.ends, SEPARATORS):
            i = bisect.bisect_right(ends, hi)
            if i and ends[i - 1] - len(s) >= lo:
                return ends[i - 1]
        return hi


def windows(body: str) -> list[tuple[int, int]]:
    """(start, stop) of overlapping windows of at most LARGE characters over a text."""
    if len(body) <= LARGE:
        return [(0, len(body))]
    places, spans = CutPlaces(body), [(0, 0)]
    while spans[-1][1] < len(body):
        before = spans[-1]
        start = max(before[0] + 1, before[1] - OVERLAP) if before[1] else 0
        far = start + LARGE
        spans.append((start, len(body) if far >= len(body) else places.last(start + OVERLAP, far)))
    return spans[1:]


def sections(body: str) -> list[tuple[str, str]]:
    """(heading path, text) of the part before the first heading and of those below each first- to third-level heading."""
    marks = list(HEADING.finditer(body))
    edges = [0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(body)]
    titles = [None, None, None]
    out = []
    for mark, start, stop in zip([None, *marks], *edges):
        if mark:
            level = len(mark[1])
            titles[level - 1 :] = [mark[2].strip(), *[None] * (3 - level)]
        out.append((" > ".join(x for x in titles if x is not None), body[start:stop].strip()))
    return out if out[0][1] else out[1:]


def without_slivers(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Runs of small sections paired off, first with second and so on, until no two small ones stand side by side; a pair keeps its first path."""
    while True:
        joined: list[tuple[str, str]] = []
        for small, run in itertools.groupby(parts, key=lambda p: len(p[1]) < SMALL):
            run = list(run)
            pairs = itertools.zip_longest(run[::2], run[1::2]) if small else ((x, None) for x in run)
            joined += [(a[0], f"{a[1]}\n\n{b[1]}".strip()) if b else a for a, b in pairs]
        if len(joined) == len(parts):
            return joined
        parts = joined


def chunks(markdown: str, title: str) -> list[tuple[str, str]]:
    """(heading path, text) of each chunk; the text opens with its document and section."""
    body = FRONT_MATTER.sub("", markdown or "").strip()
    out = []
    for path, text in without_slivers(sections(body)) if body else ():
        head = f"[Document: {title}]" + (f"\n[Section: {path}]" if path else "")
        out += [(path, f"{head}\n\n{piece}") for start, stop in windows(text) if (piece := text[start:stop].strip())]
    return out


@query("D01_chunks")
def chunk_corpus(t: Tables) -> DataFrame:
    docs = t.corpus.select("id", "title", F.concat(F.lit("# "), F.col("source_format"), F.lit("\n"), F.col("content")).alias("markdown"))

    def run(batches):
        for pdf in batches:
            rows = ((i, n, path, body) for i, title, md in zip(pdf.id, pdf.title, pdf.markdown) for n, (path, body) in enumerate(chunks(md, title)))
            yield from pieces(rows, ["id", "chunk_index", "heading_path", "text"])

    return docs.mapInPandas(run, "id bigint, chunk_index int, heading_path string, text string")


def versions(t: Tables) -> DataFrame:
    """(id, old, new): each document and its text without the lines that name a number."""
    return t.corpus.select("id", F.col("content").alias("old"), F.array_join(F.filter(line_diff.lines_of(F.col("content")), lambda x: ~x.rlike("[0-9]")), "").alias("new"))


@query("D02_diffs")
def diffs(t: Tables) -> DataFrame:
    """Lines added and removed, unified patch, flag of too large ones and summary of each document's two versions."""
    return line_diff.diff(versions(t))


@query("W11c_diff_hunks", """WITH l AS (SELECT id, UNNEST(STRING_SPLIT(content,CHR(10))) AS line, UNNEST(RANGE(LEN(STRING_SPLIT(content,CHR(10))))) AS no, LEN(STRING_SPLIT(content,CHR(10))) AS n FROM v_corpus),
r AS (SELECT id, no, REGEXP_MATCHES(line,'[0-9]') AS gone FROM l WHERE NOT (no = n-1 AND line = '')),
k AS (SELECT *, BOOL_OR(gone) OVER (PARTITION BY id ORDER BY no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, COALESCE(COUNT_IF(NOT gone) OVER (PARTITION BY id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
o AS (SELECT *, no - ROW_NUMBER() OVER (PARTITION BY id ORDER BY no) AS island FROM k WHERE near),
h AS (SELECT id, island, MIN(no)+1 AS old_start, COUNT(*) AS old_lines, MIN(before) AS before, COUNT_IF(NOT gone) AS new_lines FROM o GROUP BY 1, 2)
SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY island) AS hunk, old_start, old_lines, before + CASE WHEN new_lines > 0 THEN 1 ELSE 0 END AS new_start, new_lines, 0::BIGINT AS added, old_lines - new_lines AS removed FROM h""")
def diff_hunks(t: Tables) -> DataFrame:
    """The hunks of each document's two versions, three lines of context around a change."""
    return line_diff.hunks(line_diff.in_hunks(line_diff.edits(versions(t)))).drop("body")


@query("D04_search_documents", "SELECT c.id, SUBSTR(SHA256(CAST(c.id AS VARCHAR)),1,16) AS doc_key, title, SUBSTR(content,1,500) AS preview, is_flagged, COALESCE(n,0) AS segments FROM v_corpus c LEFT JOIN (SELECT history_id, COUNT(*) AS n FROM v_transcript_segments GROUP BY 1) s ON s.history_id = c.id")
def search_documents(t: Tables) -> DataFrame:
    extra = t.transcript_segments.groupBy(F.col("history_id").alias("id")).agg(F.count("*").alias("n"))
    return t.corpus.join(extra, "id", "left").select("id", X.short_hash(F.col("id").cast("string")).alias("doc_key"), "title", F.substring("content", 1, 500).alias("preview"), "is_flagged", F.coalesce("n", F.lit(0)).alias("segments"))


@query("D05_transcript_documents", "SELECT history_id, STRING_AGG(text,CHR(10) ORDER BY segment_index) AS content, MAX(end_seconds) AS duration, COUNT(DISTINCT speaker) AS speakers FROM v_transcript_segments GROUP BY 1")
def transcript_documents(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda s: s.text)
    return t.transcript_segments.groupBy("history_id").agg(F.array_join(parts, "\n").alias("content"), F.max("end_seconds").alias("duration"), F.countDistinct("speaker").alias("speakers"))


def structures(elements: DataFrame, key: str) -> DataFrame:
    """(key, structure): a hash of each document's shape from its elements (pos, kind, level, body): headings with levels, images, list items with depths, cells. The same for the same shape in any format."""
    all_ = F.array_sort(F.collect_list(F.struct("pos", "kind", "level", "body")))
    of = lambda kind: F.filter("e", lambda e: e["kind"] == kind)
    rows = F.flatten(F.transform(of("table_row"), lambda e: F.transform(F.split(e["body"], r"\|"), lambda c: F.trim(c))))
    cells = F.concat(F.transform(of("cell"), lambda e: e["body"]), F.filter(rows, lambda c: c != ""))
    shape = F.struct(
        F.size(of("heading")).alias("heading_count"), F.transform(of("heading"), lambda e: e["level"]).alias("heading_levels"), F.transform(of("heading"), lambda e: e["body"]).alias("heading_texts"),
        F.size(of("image")).alias("image_count"), F.size(of("list_item")).alias("list_count"), F.transform(of("list_item"), lambda e: e["level"]).alias("list_depths"), cells.alias("table_cells"),
    )
    return elements.groupBy(key).agg(all_.alias("e")).select(key, F.sha2(F.to_json(shape), 256).alias("structure"))


@query("A37b_page_structure")
def page_structures(t: Tables) -> DataFrame:
    """The structural hash of every page; headings, images, list items and cells count, prose doesn't."""
    return structures(_exploded(t.raw("pages"), "page_id", "html", html_elements), "page_id")


@query("D07_element_counts")
def element_counts(t: Tables) -> DataFrame:
    return _exploded(t.raw("pages"), "page_id", "html", html_elements).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("D08_database_summary", "SELECT 'orders' AS table_name, COUNT(*) AS n_rows, 6 AS n_columns FROM orders UNION ALL SELECT 'lineitem', COUNT(*), 11 FROM lineitem UNION ALL SELECT 'events', COUNT(*), 6 FROM events")
def database_summary(t: Tables) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "events"):
        df = t.raw(name)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("D09_path_safety", """WITH p AS (SELECT id, '/o/'||dir_id||file_ext AS out, source_path FROM v_source_files), c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY LOWER(out) ORDER BY source_path) AS rn FROM p)
SELECT id, CASE WHEN LENGTH(out) > 240 THEN NULL WHEN rn = 1 THEN out ELSE REGEXP_REPLACE(out,'(\\.[^.]+)$','_'||rn||'\\1') END AS resolved, CASE WHEN LENGTH(out) > 240 THEN 'skip' WHEN rn = 1 THEN 'ok' ELSE 'rename' END AS action FROM c""")
def path_safety(t: Tables, longest: int = 240) -> DataFrame:
    """Output paths with clashes in any case of letters numbered, too long ones skipped."""
    p = t.source_files.select("id", "source_path", F.concat(F.lit("/o/"), F.col("dir_id").cast("string"), F.col("file_ext")).alias("out"))
    p = numbered_within(p.withColumn("same", F.lower("out")), "same", "source_path").withColumn("rn", F.col("place") + 1)
    long = F.length("out") > longest
    renamed = F.concat(F.regexp_replace("out", r"\.[^.]+$", ""), F.lit("_"), F.col("rn").cast("string"), F.regexp_extract("out", r"\.[^.]+$", 0))
    return p.select("id", F.when(long, None).when(F.col("rn") == 1, F.col("out")).otherwise(renamed).alias("resolved"), F.when(long, "skip").when(F.col("rn") == 1, "ok").otherwise("rename").alias("action"))


@query("D10_budgeted_read", "SELECT id, SUBSTR(content,1,1000) AS body, LENGTH(content) > 1000 AS cut FROM v_corpus")
def budgeted_read(t: Tables, most: int = 1000) -> DataFrame:
    return t.corpus.select("id", F.substring("content", 1, most).alias("body"), (F.length("content") > most).alias("cut"))


@query("D11_summary_card", "SELECT id, title, lang, source_format, LENGTH(content) AS chars, LENGTH(content)-LENGTH(REPLACE(content,CHR(10),''))+1 AS lines FROM v_corpus")
def summary_card(t: Tables) -> DataFrame:
    return t.corpus.select("id", "title", "lang", "source_format", F.length("content").alias("chars"), F.size(F.split("content", "\n")).alias("lines"))
