"""Expected values of single operators, and edge cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import aggregates, documents, lifecycle, predicates, search
from docspark.sources import files


def values(spark, column, rows, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(column).collect()]


def test_filename(spark):
    found = values(spark, X.normalized_filename(F.col("x")), ["getUserName.js", "my_file-v2.tar.gz", "XMLParser2024.pdf", "plain", ""])
    assert found == ["get User Name", "my file v 2", "XML Parser 2024", "plain", ""]


def test_query_openings(spark):
    found = values(spark, X.preprocessed_query(F.col("x")), ["what are the data retention rules", "what", "show me the plan", "whatever happens", "pending files"])
    assert found == ["data retention rules", "", "plan", "whatever happens", "pending files"]


def test_times(spark):
    assert values(spark, X.clock(F.col("x")), [3723.0, 0.0], "x double") == ["01:02:03", "00:00:00"]
    assert values(spark, X.caption_time(F.col("x"), ","), [3661.125], "x double") == ["01:01:01,125"]
    assert values(spark, X.seconds_of(F.col("x")), ["01:01:01,125", "00:05.5"]) == [3661.125, 5.5]


def test_content_hash_ignores_case_and_space(spark):
    a, b, c = values(spark, X.content_hash(F.col("x")), ["Hello  World", " hello\nworld ", "other"])
    assert a == b != c and len(a) == 16


def test_headings(spark):
    assert values(spark, X.headings(F.col("x")), ["# Title\n## Section\ntext\n### Subsection\n#### no"]) == [["Title", "Section", "Subsection"]]


def test_truncate(spark):
    assert values(spark, X.truncated(F.col("x"), 10), ["short", "12345678\n0123", "1\n345678901"]) == ["short", "12345678\n"[:8], "1\n34567890"]


def test_chunks():
    assert documents.chunks("", "X") == [] and documents.chunks("---\na: 1\n---\n", "X") == []
    body = "# A\n" + "word " * 900 + "\n## B\nshort\n## C\ntiny"
    found = documents.chunks(body, "X")
    assert all(text.startswith("[Document: X]") for _, text in found)
    assert found[-1][0] == "A > B" and "tiny" in found[-1][1]


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n", max_size=9000))
def test_windows_cover_the_text(body):
    spans = documents.windows(body)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(0 <= stop - start <= documents.LARGE for start, stop in spans)
    for before, after in zip(spans, spans[1:]):  # in order, overlapping, with no gap
        assert before[0] < after[0] <= before[1] < after[1] and before[1] - after[0] <= documents.OVERLAP


def test_html():
    rows = documents.html_elements("<title>T</title><h2>A &amp; B</h2><p>one<br>two</p><ul><li>x</ul><script>no</script>end<img alt=pic>")
    assert rows == [("title", 0, "T"), ("heading", 2, "A & B"), ("paragraph", 0, "onetwo"), ("list_item", 0, "x"), ("paragraph", 0, "end"), ("image", 0, "pic")]
    assert documents.html_elements(None) == []


def test_markdown():
    rows = documents.markdown_elements("# H\n\npara\nmore\n- item\n> q\n---\n```py\ncode\n```\n| a | b |\n|---|---|")
    assert [r[0] for r in rows] == ["heading", "paragraph", "list_item", "blockquote", "hr", "code_block", "table_row"]


def test_batch_cost_goldens(spark):
    rates = spark.createDataFrame([("p", "m", 15.0, 75.0), ("q", "*", 1.0, 3.0)], "provider_id string, model string, input_rate double, output_rate double")
    rows = spark.createDataFrame([("p", "m", 300_000), ("q", "any", 1_000_000), ("z", "m", 5)], "provider_id string, model string, tokens long")
    found = aggregates.with_rates(rows, rates).select("provider_id", aggregates.blended_cost(F.col("tokens")).alias("c")).collect()
    assert {r[0]: r[1] for r in found} == {"p": 13.5, "q": 2.0, "z": None}


def test_upsert_keeps_what_rows_dont_have(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    rows = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in lifecycle.upsert(table, rows, "k").collect()} == {(1, "a", "x"), (2, None, "y"), (3, "c", None)}


def test_transitions(spark):
    cases = [("active", "missing"), ("in_trash", "restored"), ("marked_for_deletion", "grace_over"), ("in_trash", "retention_over"), ("purged", "restored")]
    df = spark.createDataFrame(cases, "s string, e string")
    assert [r[0] for r in df.select(lifecycle.transition(F.col("s"), F.col("e"))).collect()] == ["marked_for_deletion", "active", "in_trash", "purged", "purged"]


def test_refusals(spark):
    with pytest.raises(ValueError):
        predicates.sorted_by(spark.range(1), "drop table", True)
    with pytest.raises(ValueError):
        predicates.reanalyze_selector(None, status=None)


def test_index_percentile(spark):
    rows = [("a", float(i)) for i in range(100)] + [("b", 0.0)] * 50 + [("b", float(i)) for i in range(1, 51)] + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    for share, want in ((0.95, {"a": 95.0, "b": 46.0, "d": 7.0}), (0.25, {"a": 25.0, "b": 0.0, "d": 7.0}), (0.5, {"a": 50.0, "b": 1.0, "d": 7.0})):
        assert {r.k: r.p for r in aggregates.index_percentile(df, "k", "x", share, "p").collect()} == want


def test_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_settings_and_junk(spark):
    df = spark.createDataFrame([(1, "a=1\n[s]\n; c\nb : two words \n"), (2, ""), (3, None)], "id int, ini string")
    assert [tuple(r) for r in files.settings(df, "ini").collect()] == [(1, "", "a", "1"), (1, "s", "b", "two words")]
    assert values(spark, files.is_junk(F.col("x")), ["/a/~$doc.docx", "/a/Thumbs.db", "/a/doc.pdf"]) == [True, True, False]
    assert values(spark, files.extension(F.col("x")), ["/a/b.TAR.gz", "/a.b/c", "x.pdf"]) == [".tar.gz", "", ".pdf"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "source_path string, source_mtime timestamp, file_size_bytes long, lifecycle_status string")
    assert lifecycle.classify(empty, empty).count() == 0
    assert aggregates.zero_filled(spark.createDataFrame([], "status string, n long"), "status", ["a", "b"]).count() == 2


def test_cycle(spark):
    days = [dt.datetime(2024, 3, 20), dt.datetime(2024, 3, 10), dt.datetime(2024, 1, 1)]
    assert values(spark, X.cycle_start(F.col("x"), 15), days, "x timestamp") == [dt.date(2024, 3, 15), dt.date(2024, 2, 15), dt.date(2023, 12, 15)]


def test_ewma_is_the_fold_over_all_rows(spark, tmp_path, monkeypatch):
    import random

    from docspark.operators import windows
    from docspark.sources.tables import Tables

    monkeypatch.setattr(windows, "BLOCK_ROWS", 7)
    monkeypatch.setattr(windows, "FOLD", 3)
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.random() * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double").selectExpr("event_id", "event_type", "value", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id div 3) as ts", "1L as user_id", "'{}' as props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i, kind, x in sorted(rows, key=lambda r: (r[0] // 3, r[0])):
        want[kind] = 0.3 * x + 0.7 * want[kind] if kind in want else x
    assert {r.event_type: r.ewma for r in windows.ewma(Tables(spark, str(tmp_path))).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_a_rebuild_stops_on_errors(spark, tmp_path):
    from docspark.operators import maintenance

    folder = f"file://{tmp_path}/index"
    rows = lambda n, bad: spark.createDataFrame([(i, None if i < bad else "t") for i in range(n)], "id int, title string")
    run = lambda n, bad: maintenance.rebuild(rows(n, bad), F.col("title").isNull(), folder)
    now = lambda: sorted(r.id for r in spark.read.parquet(folder).collect())
    assert run(20, 3) == (17, 3) and now() == list(range(3, 20))
    with pytest.raises(maintenance.RebuildStopped, match="30 of 60"):
        run(60, 30)
    assert now() == list(range(3, 20))  # the old index is as it was
    with pytest.raises(Exception):
        maintenance.rebuild(rows(20, 0).withColumn("x", F.raise_error(F.lit("broken"))), F.col("title").isNull(), folder)
    assert now() == list(range(3, 20))
    assert run(9, 8) == (1, 8) and now() == [8]  # too few rows to judge
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
