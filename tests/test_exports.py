"""Exports and files read back, on texts that are empty, blank or missing."""

import duckdb
import pytest
from oracle import difference

from docspark import catalog
from docspark.sinks.exporters import rtf
from docspark.sources import containers

TEXTS = [None, "", " ", "\n \n", "a", "a,b\nc", '"', '""', 'say "x"', '"x\ny"\r\nz', "a\rb", "\\", '\\"', "#c", "null", "\\N", "\t", " lead", "trail  ", "é\ufeff\x00z", "\x00\na", 'a\x00"b', "\x00,\x00", "x" * 59 + '"', "x" * 59 + "\r\n", "😀" * 70]


def corpus(spark, folder, texts):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


SPACES = ["\u00a0", "a\n\u3000\nb", "\u2007 x", "\u2028", "{\\info x}", "{\\*\\fonttbl {a}}", "\\par x\\'41"]
KINDS = ["S22_archive", "S24_docx", "S26_pptx", "S27_xlsx", "S28_odt", "S29_rtf"]


@pytest.mark.parametrize("query", ["K10_csv_export", *(f"{kind}_round_trip" for kind in KINDS)])
def test_odd_texts(spark, tmp_path, query):
    con = corpus(spark, str(tmp_path), TEXTS + SPACES)
    assert difference(catalog.QUERIES[query](spark, str(tmp_path)), con, catalog.ORACLE_SQL[query]) == ""


def test_empty_and_missing_are_told_apart(spark, tmp_path):
    from docspark.sinks import writers

    rows = [(1, ""), (2, None), (3, "null"), (None, ""), (None, None)]
    writers.export_csv(spark.createDataFrame(rows, "id long, title string"), str(tmp_path / "csv"))
    found = writers.exported_csv(spark, str(tmp_path / "csv"), "id long, title string").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("lines", [[], [""], ["a", ""], ["", "", "a"], [" a ", "\t", "{}", "\\"], ["é?", "{\\info x}"]])
def test_rich_text_has_the_lines_written(lines):
    assert [body for _, body in containers.rtf(rtf(lines))] == lines


def test_rich_text_of_others():
    read = lambda data: [body for _, body in containers.rtf(data)]
    assert read(b"{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\info{\\title a\\}b}}\\f0 one\\par two}") == ["one", "two"]
    assert read(b"{\\rtf1\\ansi one\\par two\\par}") == ["one", "two"]
