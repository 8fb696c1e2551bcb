"""What a Python worker holds at once is bounded, whatever the rows of a task; the results are the same."""

import random

import pytest

from docspark.functions import pieces as P
from docspark.operators import documents
from docspark.sinks.exporters import WRITERS
from docspark.sources import containers


class Now:
    """Stands for the frame, and runs a function of batches here and now."""

    def __init__(self, batches):
        self.batches, self.sizes, self.pulled = batches, [], 0

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        def given():
            for b in self.batches:
                self.pulled += 1
                yield b

        return run(given())


def texts(n, seed=1):
    rng = random.Random(seed)
    return [[" ".join(rng.choices(["alpha", "be&ta", "<g>", "d{e}lta", "éß€"], k=12)) for _ in range(10)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["xlsx", "docx", "pptx", "odt", "rtf", "zip"])
def test_files_are_written_and_read_in_pieces(kind, monkeypatch):
    """One large batch, as of a task with many rows: no frame holds more than a piece."""
    import pandas as pd

    monkeypatch.setattr(P, "ROWS", 50)
    lines = texts(120)
    files = list(containers.write(Now([pd.DataFrame({"id": range(120), "lines": lines})]), "id", "lines", kind))
    assert [len(f) for f in files] == [50, 50, 20]
    whole = pd.DataFrame({"id": range(120), "content": [WRITERS[kind](x) for x in lines]})
    rows = list(containers.read(Now([whole]), "id", kind))
    assert max(map(len, rows)) <= 50 and len(rows) == 24
    assert [(r.id, r.pos, r.body) for f in rows for r in f.itertuples()] == [(i, k, x) for i, t in enumerate(lines) for k, x in enumerate(t)]


def test_files_are_parsed_one_by_one(monkeypatch):
    """A piece leaves before the rest of its batch is read."""
    import pandas as pd

    seen = []
    monkeypatch.setitem(containers.READERS, "probe", lambda data: seen.append(1) or [("paragraph", "x" * 1000)] * 10)
    monkeypatch.setattr(P, "CHARACTERS", 20_000)
    got = containers.read(Now([pd.DataFrame({"id": range(100), "content": [b"x"] * 100})]), "id", "probe")
    next(got)
    assert len(seen) == 2


def test_elements_in_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(P, "ROWS", 7)
    whole = pd.DataFrame({"id": range(20), "body": ["# a\n\nb\n\n- c\n"] * 20})
    rows = list(documents._exploded(Now([whole]), "id", "body", documents.markdown_elements))
    assert max(map(len, rows)) <= 7 and sum(map(len, rows)) == 60
    assert pd.concat(rows).body.tolist() == ["a", "b", "c"] * 20


def test_batches_are_held(spark):
    from docspark.sources.tables import Tables

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        Tables(spark, "/root/testdata/sf0.001")

        def sizes(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"n": [len(pdf)], "size": [int(pdf.text.str.len().sum())]})

        long = spark.range(1200, numPartitions=1).selectExpr("id", "repeat('x', 50000) as text").mapInPandas(sizes, "n long, size long").collect()
        short = spark.range(9000, numPartitions=1).selectExpr("id", "'x' as text").mapInPandas(sizes, "n long, size long").collect()
        assert sum(r.n for r in long) == 1200 and max(r.size for r in long) < 10 << 20
        assert sum(r.n for r in short) == 9000 and max(r.n for r in short) <= 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("given, held", [("16m", "4194304"), ("64MB", "4194304"), ("1g", "4194304"), ("4194304", "4194304"), ("2m", "2m"), ("100k", "100k"), ("100b", "100b")])
def test_limits_with_units_are_held(spark, given, held):
    """Sizes may be set with a unit, as 16m; any query on the corpus tables failed then."""
    from docspark.session import bound_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, given)
        bound_batches(spark)
        assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, old)


def most_held(text, parse):
    """(elements, bytes held at most) while one long text is parsed, beside the text."""
    import tracemalloc

    import pandas as pd

    frame = pd.DataFrame({"id": [1], "body": [text]})
    tracemalloc.start()
    try:
        return sum(map(len, documents._exploded(Now([frame]), "id", "body", parse))), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_long_markdown_is_parsed_bit_by_bit():
    """A text's elements leave as they end; before, all of them and all lines were held at once."""
    n, most = most_held("a b\n\n- c\n\n" * 50_000, documents.markdown_blocks)
    assert n == 100_000 and most < 4 << 20


def test_round_trip_counts(spark):
    """D03 against a plain count."""
    from collections import Counter

    from docspark import catalog

    def line(kind, level, body):
        marks = {"heading": "#" * max(level, 1) + " " + body, "list_item": "- " + body, "blockquote": "> " + body, "code_block": f"```\n{body}\n```", "hr": "---"}
        return marks.get(kind, body)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    first, again = Counter(), Counter()
    for p in pages:
        rows = documents.html_elements(p.html)
        first.update((p.page_id, kind) for kind, _, _ in rows)
        again.update((p.page_id, kind) for kind, _, _ in documents.markdown_elements("\n\n".join(line(*r) for r in rows)))
    got = catalog.QUERIES["D03_document_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.page_id, r.kind): (r.parsed, r.reparsed) for r in got} == {k: (first[k], again[k]) for k in first | again} and len(got) == len(first | again)


def test_long_second_reading_is_parsed_bit_by_bit(monkeypatch):
    """D03 reads its Markdown so that the elements of a long page leave as they end."""
    parsers = {}

    class Frame(Now):
        def __getattr__(self, name):
            return lambda *a, **k: self

    frame = Frame([])
    frame.raw = lambda name: frame
    monkeypatch.setattr(documents, "render_markdown", lambda t: frame)
    monkeypatch.setattr(documents, "_exploded", lambda df, id_, column, parse: parsers.update({column: parse}) or frame)
    monkeypatch.setattr(documents.F, "count", lambda x: frame)
    documents.document_round_trip(frame)
    monkeypatch.undo()
    n, most = most_held("# a\n\nb\n\n> c\n\n" * 50_000, parsers["markdown"])
    assert n == 150_000 and most < 4 << 20
