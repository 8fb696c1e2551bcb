"""The stored index against a scan of all texts: top lists, change sets, ranking rules."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.operators import postings_index
from docspark.operators.postings_index import Index, Layout
from docspark.plans import inspect

SCHEMA = "id long, title string, content string, is_flagged boolean"
WORDS = ["planning", "plannning", "plaining", "river", "rivers", "stone", "stony", "budget", "budgets", "a", "of", "the", "retention", "retentoin", "retntion", "x1", "meeting", "meetings"]


def words_of(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def corpus(n, seed=1):
    rng = random.Random(seed)
    some = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS[: rng.choice([4, 18])]) for _ in range(k))
    rows = [(i, some(rng.randint(0, 4)), some(rng.randint(0, 40)), rng.random() < 0.2) for i in range(n)]
    return rows + [(10_000, None, None, False), (10_001, "", "", False), (None, "river", "river", False), (10_002, "River", "The RIVER-stone! é river", None)]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/index"


def scan(rows, terms, k, flagged=False):
    found = []
    for i, _, content, flag in rows:
        have = [w for w in words_of(content) if w in terms]
        if i is not None and have and (flagged or flag is False):
            found.append((-len(set(have)), -len(have), i))
    return [(i, -a, -b) for a, b, i in sorted(found)[:k]]


def test_top_lists_equal_a_scan(spark, folder):
    rows = corpus(400)
    index = Index(spark, folder, Layout(buckets=8, block_ids=16, blocks_a_task=2))
    index.build(spark.createDataFrame(rows, SCHEMA))
    rng = random.Random(2)
    sets = [rng.sample(WORDS, rng.randint(1, 4)) for _ in range(20)] + [["absent"], ["river", "absent"], [""]]
    for terms in sets:
        for k in (1, 5):
            assert [tuple(r)[:3] for r in index.top(terms, k, F.expr("not is_flagged")).select("id", "words", "tf").collect()] == scan(rows, terms, k), terms
    assert {tuple(r) for r in index.hits(["river", "of"]).collect()} == {tuple(x) for x in scan(rows, ["river", "of"], 10**6, True)}
    assert index.top(["river"], 3).columns == ["id", "words", "tf", "title", "is_flagged"]


def test_a_query_reads_its_buckets_and_blocks_alone(spark, folder):
    rows = [(i, "t", "common " * (1 + (i == 777)) + ("rare" if i == 5 else ""), False) for i in range(2000)]
    index = Index(spark, folder, Layout(buckets=16, block_ids=32))
    index.build(spark.createDataFrame(rows, SCHEMA))
    plan = inspect.physical(index.postings_of(["rare"]))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+\)\]", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan), plan
    top = index.top(["common"], 1)
    assert [r.id for r in top.collect()] == [777]
    bounds = {r.block: r.tf for r in index.bounds(["common"]).collect()}
    assert bounds.pop(777 // 32) == 2 and set(bounds.values()) == {1}  # all other blocks are below the mark


def test_change_sets_and_merge_equal_a_rebuild(spark, folder, tmp_path):
    rows = corpus(120)
    layout = Layout(buckets=4, block_ids=16)
    index = Index(spark, folder, layout)
    index.build(spark.createDataFrame(rows, SCHEMA))
    state = {r[0]: r for r in rows if r[0] is not None}
    changes = "op string, " + SCHEMA
    rng = random.Random(3)
    for turn in range(3):
        ids = rng.sample(range(140), 25)
        fresh = [("upsert", i, f"turn {turn}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))), False) for i in ids[:15]]
        gone = [("Delete", i, None, None, None) for i in ids[15:]]
        index.apply(spark.createDataFrame(fresh + gone, changes))
        state |= {r[1]: r[1:] for r in fresh}
        for r in gone:
            state.pop(r[1], None)
    index.apply(spark.createDataFrame([("delete", 0, None, None, None)], changes))  # a change set without texts
    state.pop(0, None)
    now = list(state.values())
    again = Index(spark, f"file://{tmp_path}/again", layout)
    again.build(spark.createDataFrame(now, SCHEMA))

    def seen(x):
        tops = [[tuple(r) for r in x.top(list(t), 7, F.expr("not is_flagged")).select("id", "words", "tf", "title").collect()] for t in itertools.combinations(WORDS[3:9], 2)]
        return tops, sorted(map(tuple, x.vocabulary().collect())), sorted(map(str, x.docs().collect()))

    assert seen(index) == seen(again) and len(index.segments()) == 5
    index.merge()
    assert seen(index) == seen(again) and len(index.segments()) == 1
    assert [(i, w, n) for i, w, n, _ in seen(index)[0][0]] == scan(now, WORDS[3:5], 7)
    with pytest.raises(Exception, match="unknown op"):
        index.apply(spark.createDataFrame([("drop", 1, None, None, None)], changes))
    assert seen(index) == seen(again)  # what failed half-way doesn't count


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_ranked(rows, terms, k):
    out = []
    for i, title, content, _ in rows:
        if i is None:
            continue
        each, places = [], []
        for n, t in enumerate(terms):
            most = 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
            met = [(edits(t, w), a, p) for a, text in enumerate((title, content)) for p, w in enumerate(words_of(text)) if edits(t, w) <= most]
            if met:
                each.append((min(m[0] for m in met), min(m[1] for m in met)))
                places.append([m[1] * 10**9 + m[2] for m in met])
        if each:
            span = min(max(c) - min(c) for c in itertools.product(*places))
            near = min(max(span - (len(each) - 1), 0), 8 * (len(each) - 1))
            out.append((-len(each), sum(e[0] for e in each), near, sum(e[1] > 0 for e in each), -sum(e[0] == 0 for e in each), i))
    return [(i, -w, t, p, a, -x) for w, t, p, a, x, i in sorted(out)[:k]]


@pytest.mark.parametrize("terms", [["river", "stone"], ["planning"], ["retention", "budget", "the"], ["meetings", "x1", "rivers", "of"], ["retentionx", "th"], ["zzzzzz"]])
def test_ranking_rules_against_brute_force(spark, folder, terms, monkeypatch):
    rows = [(i, t, " ".join(words_of(c)[:8]), f) for i, t, c, f in corpus(150, seed=7)]
    index = Index(spark, folder, Layout(buckets=4, block_ids=32))
    index.build(spark.createDataFrame(rows, SCHEMA))
    columns = ("id", "words", "typos", "proximity", "attribute", "exactness")
    want = brute_ranked(rows, terms, 25)
    assert [tuple(r) for r in index.ranked(terms, 25).select(*columns).collect()] == want
    monkeypatch.setattr(postings_index, "MOST_LISTED", 1)
    assert [tuple(r) for r in index.ranked(terms, 25).select(*columns).collect()] == want


def test_every_word_in_reach_is_found(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(400)} | {"a" * 60, "b" * 41})
    near = postings_index.neighbourhood(spark.createDataFrame([(w,) for w in words], "token string")).collect()
    of = {}
    for r in near:
        of.setdefault(r.variant, set()).add(r.token)
    for term in rng.sample(words, 60):
        most = 0 if len(term) > 40 else 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        mine = {"".join(c for k, c in enumerate(term) if k not in gone) for n in range(most + 1) for gone in itertools.combinations(range(len(term)), n)}
        reached = {t for v in mine for t in of.get(v, ())}
        assert {w for w in words if edits(term, w) <= most} <= reached


def test_an_index_of_nothing(spark, folder):
    index = Index(spark, folder)
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.top(["a"], 3).count() == 0 and index.ranked(["a"], 3).count() == 0 and index.vocabulary().count() == 0
    index.apply(spark.createDataFrame([("upsert", 1, "T", "a b a", False)], "op string, " + SCHEMA))
    assert [tuple(r)[:3] for r in index.top(["a"], 3).select("id", "words", "tf").collect()] == [(1, 1, 2)]


def test_derived_queries_against_brute_force(spark, folder):
    import math

    rows = [r for r in corpus(90, seed=5) if r[0] is not None]
    index = Index(spark, folder, Layout(buckets=4, block_ids=16))
    index.build(spark.createDataFrame(rows, SCHEMA))
    index.apply(spark.createDataFrame([("upsert", 3, "t", "river river stony x1 budget", False), ("delete", 4, None, None, None)], "op string, " + SCHEMA))
    now = {r[0]: r[2] for r in rows if r[0] != 4} | {3: "river river stony x1 budget"}
    df = {}
    for text in now.values():
        for w in set(words_of(text)):
            df[w] = df.get(w, 0) + 1
    weights = {i: {w: words_of(x).count(w) * math.log(1 + len(now) / df[w]) for w in set(words_of(x))} for i, x in now.items()}
    for doc in (3, 10, 11, 10_001):
        best = sorted(weights[doc].items(), key=lambda p: (-round(p[1], 9), p[0]))[:4]
        got = index.derived_query(now[doc], 4)
        assert [w for w, _ in got] == [w for w, _ in best] and [x for _, x in got] == pytest.approx([x for _, x in best])
        score = {i: sum(q * v[w] for w, q in best if w in v) / math.sqrt(sum(x * x for x in v.values())) for i, v in weights.items() if i != doc and any(w in v for w, _ in best)}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert [r.id for r in index.related(now[doc] or "", 5, doc, 4).collect()] == want
