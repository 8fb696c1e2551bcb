"""Chunks, query preparation and readers, on values written by hand."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators.documents import LARGE, chunks, sections, windows, without_slivers
from docspark.sources import containers


def test_chunks_of_little_text():
    assert chunks("", "Empty") == chunks("   \n\n  ", "Blank") == chunks("---\ntitle: only\n---\n", "Front") == []
    assert chunks("# Title\n\nSome content here.", "My Doc") == [("Title", "[Document: My Doc]\n[Section: Title]\n\nSome content here.")]
    assert chunks("Preamble.", "Doc") == [("", "[Document: Doc]\n\nPreamble.")]
    assert chunks("---\ntitle: Doc\n...\n# A\n\nText.", "D") == [("A", "[Document: D]\n[Section: A]\n\nText.")]


def test_heading_paths():
    body = "A" * 250
    markdown = f"# One\n\n{body}\n\n## Over\n\n{body}\n\n### Deep\n\n{body}\n\n## Next\n\n{body}\n\n#### no cut\n# Two\n\n{body}"
    assert [p for p, _ in chunks(markdown, "B")] == ["One", "One > Over", "One > Over > Deep", "One > Next", "Two"]
    assert sections("### Alone\n\nx") == [("Alone", "x")]


def test_small_sections_are_paired():
    markdown = "\n\n".join(f"# Section {i}\n\nContent {i}." for i in range(5))
    assert chunks(markdown, "D") == [("Section 0", "[Document: D]\n[Section: Section 0]\n\n" + "\n\n".join(f"Content {i}." for i in range(5)))]
    small, large = "s" * 90, "l" * 300
    assert without_slivers([(x, small) for x in "abcd"]) == [("a", "\n\n".join([small] * 4))]  # 182 and 182 characters in between
    assert without_slivers([(x, "m" * 150) for x in "abcd"]) == [("a", "m" * 150 + "\n\n" + "m" * 150), ("c", "m" * 150 + "\n\n" + "m" * 150)]
    assert without_slivers([("a", large), ("b", small), ("c", large), ("d", "")]) == [("a", large), ("b", small), ("c", large), ("d", "")]
    assert chunks(f"# Top\n## Sub\nshort\n## Long\n{large}", "D")[0][0] == "Top"


def test_windows_of_a_long_section():
    assert windows(("word " * 1000).strip()) == [(0, 1600), (1400, 3000), (2800, 4400), (4200, 4999)]
    assert windows("x" * 1601) == [(0, 1600), (1400, 1601)]
    paragraphs = "a" * 900 + "\n\n" + "b" * 500 + ". " + "c" * 900
    assert windows(paragraphs) == [(0, 902), (702, 1404), (1204, 2304)]
    assert all(stop - start <= LARGE for start, stop in windows("One sentence here. " * 700))


@pytest.mark.parametrize(
    "query, want, recent",
    [
        ("FIND ME THE handbook", "handbook", False), ("What Are The rules", "rules", False), ("where does the report live", "does the report live", False), ("how is the plan", "is the plan", False),
        ("  expense form  ", "expense form", False), ("vendor\t  agreement\nnotes", "vendor agreement notes", False), ("what is the latest expense policy", "latest expense policy", True), ("", "", False),
        ("can you find me the refund policy?", "refund policy?", False), ("news of yesterday", "news of yesterday", False), ("is it up to date now", "is it up to date now", True), ("i want to know about the handbook", "handbook", False), ("whatever works", "whatever works", False),
    ],
)
def test_query_preparation(spark, query, want, recent):
    row = spark.createDataFrame([(query,)], "q string").select(X.preprocessed_query(F.col("q")).alias("a"), X.asks_for_recent(F.col("q")).alias("b")).first()
    assert (row.a, row.b) == (want, recent)


def test_confidence_and_truncation(spark):
    rows = [('"exact words"', 1), ('"exact words"', 0), ("single", 5), ("single", 4), ("two words", 90), ('""', 3)]
    got = spark.createDataFrame(rows, "q string, n long").select(X.keyword_is_confident(F.col("q"), F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False]
    texts = ["short", "a" * 60 + "\n\n" + "b" * 20 + "\nc" + "d" * 40, "a" * 60 + "\n" + "b" * 60, "a" * 20 + "\n\n" + "b" * 100, "a" * 98 + "  " + "c" * 9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(X.truncated(F.col("t"), 100)).collect()]
    assert got == ["short", "a" * 60, "a" * 60, "a" * 20 + "\n\n" + "b" * 78, "a" * 98]


def test_best_matches_by_brute_force():
    import difflib
    import random

    from docspark.operators.joins import best_matches

    rng = random.Random(4)
    stored = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    elements = ["".join(rng.choice("abcd") if rng.random() < 0.06 else c for c in rng.choice(stored)) for _ in range(40)] + [""]
    want = []
    for i, x in enumerate(elements):
        ratios = [difflib.SequenceMatcher(None, x, y).ratio() for y in stored]
        if x and max(ratios) >= 0.9:
            want.append((i, ratios.index(max(ratios)), max(ratios)))
    assert best_matches(elements, stored, 0.9) == want and len(want) > 20


def packed(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_D", "."), body)
    return out.getvalue()


def test_docx_of_another_writer():
    w = 'xmlns:w="urn:w"'
    p = lambda text, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda *x: "<w:tc>" + "".join(map(p, x)) + "</w:tc>"
    body = p("Main", '<w:pStyle w:val="Heading1"/>') + p("one", '<w:numPr/>') + f'<w:p><w:r><w:t>split </w:t></w:r><w:r><w:tab/><w:t>run</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b", "c")}</w:tr><w:tr>{cell("d")}{cell("")}</w:tr></w:tbl>'
    data = packed(word__document_Dxml=f"<w:document {w}><w:body>{body}<w:sectPr/></w:body></w:document>", word__footnotes_Dxml=f'<w:footnotes {w}><w:footnote w:type="separator">{p("-")}</w:footnote><w:footnote>{p("see there")}</w:footnote></w:footnotes>')
    assert containers.docx(data) == [("heading1", "Main"), ("list_item", "one"), ("paragraph", "split \trun"), ("table_row", "a\tb\nc"), ("table_row", "d\t"), ("note", "see there")]


def test_xlsx_of_another_writer():
    s = 'xmlns="urn:s" xmlns:r="urn:r"'
    data = packed(
        xl__workbook_Dxml=f'<workbook {s}><sheets><sheet name="Later" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></workbook>',
        **{"xl___rels__workbook_Dxml_Drels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>'},
        xl__sharedStrings_Dxml=f"<sst {s}><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        xl__worksheets__sheet1_Dxml=f'<worksheet {s}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>4.5</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells></worksheet>',
        xl__worksheets__sheet2_Dxml=f'<worksheet {s}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
    )
    assert containers.xlsx(data) == [("heading1", "Later"), ("table_row", "7"), ("heading1", "First"), ("table_row", "\trich\trich\t4.5"), ("table_row", "TRUE\trich\trich")]


def test_pptx_epub_and_project():
    a = 'xmlns:p="urn:p" xmlns:a="urn:a"'
    par = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    slide = f'<p:sld {a}><p:sp><p:ph type="title"/>{par("Head")}</p:sp><p:sp>{par("point")}</p:sp><a:tbl><a:tr><a:tc>{par("x")}</a:tc><a:tc>{par("y")}</a:tc></a:tr></a:tbl></p:sld>'
    data = packed(ppt__slides__slide10_Dxml=f"<p:sld {a}>{par('last')}</p:sld>", ppt__slides__slide2_Dxml=slide, ppt__notesSlides__notesSlide2_Dxml=f"<p:notes {a}>{par('say this')}</p:notes>")
    assert containers.pptx(data) == [("heading1", "Head"), ("paragraph", "point"), ("table_row", "x\ty"), ("note", "say this"), ("paragraph", "last")]
    book = packed(
        **{"META-INF__container_Dxml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'},
        OPS__book_Dopf='<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        OPS__a_Dxhtml="<html><body><p>second</p></body></html>", OPS__b_Dxhtml="<html><body><h1>First</h1></body></html>",
    )
    assert [body for _, body in containers.epub(book)] == ["First", "second"]
    xml = "<P><Sequence><Name>cut</Name></Sequence><BinProjectItem><Name>bin</Name></BinProjectItem><Media><FilePath>/m/1</FilePath></Media><Media><FilePath>/m/1</FilePath></Media></P>"
    assert containers.project(gzip.compress(xml.encode())) == [("sequence", "cut"), ("bin", "bin"), ("media", "/m/1")]


def test_yaml_outline():
    pytest.importorskip("yaml")
    assert containers.yaml_outline(b"a: 1\nb:\n- x\n- {c: true}\n---\nd: 2024-01-02\n") == [("$.a", "1"), ("$.b[0]", '"x"'), ("$.b[1].c", "true"), ("$.d", '"2024-01-02"')]


def test_structures_of_two_formats(spark):
    from pyspark.sql import functions as F

    from docspark.operators import documents

    html = ["<h1>A</h1><p>one</p><ul><li>x</li><li>y</li></ul><table><tr><td>p</td><td>q</td></tr></table><h2>B</h2>", "<h1>A</h1><h3>B</h3>", "<p>no shape</p>"]
    markdown = ["# A\n\nother prose\n\n- x\n- y\n\n| p | q |\n\n## B", "# A\n\n## B", "prose\n\nprose"]
    rows = spark.createDataFrame([(i, h, m) for i, (h, m) in enumerate(zip(html, markdown))], "id long, html string, markdown string")
    of = lambda column, parse: {r.id: r.structure for r in documents.structures(documents._exploded(rows, "id", column, parse), "id").collect()}
    a, b = of("html", documents.html_elements), of("markdown", documents.markdown_elements)
    assert a[0] == b[0] and a[2] == b[2] and a[1] != b[1] and len(set(a.values())) == 3
    title = lambda x: spark.createDataFrame([(x,)], "x string").select(documents.X.document_title(F.col("x"), F.lit("stem"))).first()[0]
    assert [title(x) for x in ("---\ntitle: T\nb: c\n---\n# H", "---\na: 1\n---\n## H \ntext", "text\n### Deep", "#no", "", "#### four", "---\ntitle:\n---\n# H")] == ["T", "H", "Deep", "stem", "stem", "stem", "H"]
