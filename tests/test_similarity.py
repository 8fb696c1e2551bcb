"""The similarity join against all pairs."""

import random
import re

import pytest

from docspark.operators import similarity
from docspark.plans import inspect

SCHEMA = "id long, text string"


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text).strip(" ").lower()


def grams(text):
    return {text[i : i + 3] for i in range(max(len(text) - 2, 1))} if text else set()


def brute(rows, percent):
    of, out = {}, {}
    for i, text in set(rows):
        if i is not None and text is not None:
            of.setdefault(norm(text), set()).add(i)
    sets = {text: grams(text) for text in of}
    for i, mine in {(i, text if text is None else norm(text)) for i, text in rows if i is not None}:
        if mine is None:
            out.setdefault(i, []).append((i, i, 0, None, None))
            continue
        links, best = len(of[mine]) - 1, None
        for other, g in sets.items():
            both = len(g & sets[mine])
            if other != mine and both and 100 * both >= percent * len(g | sets[mine]):
                links += len(of[other])
                best = max(best or (-1, 0), (both / len(g | sets[mine]), -min(of[other])))
        found = (i, min(of[mine]), links, -best[1] if best else None, round(best[0], 6) if best else None)
        out.setdefault(i, []).append(found)
    return sorted((x for v in out.values() for x in v), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice(["x", "", "é", "\n"])
        rows.append((i, "".join(text).upper() if rng.random() < 0.2 else "".join(text)))
    return rows + [(900, None), (901, ""), (902, "  "), (None, "abc"), rows[0], rows[0], (903, "a"), (904, "ab"), (905, "A\tb "), (3, "a second text of one id"), (906, "long " * 4000)]


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_equals_all_pairs(spark, percent):
    rows = texts(percent, 160)
    got = similarity.similar(spark.createDataFrame(rows, SCHEMA).repartition(3), percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, percent)


def test_first_letters_may_differ_and_hot_texts_are_one(spark):
    rows = [(i, "the very same title of many rows") for i in range(300)] + [(500, "ohe very same title of many rows"), (501, "nothing like it at all here")]
    got = {r.id: tuple(r)[1:] for r in similarity.similar(spark.createDataFrame(rows, SCHEMA), 80).collect()}
    assert got[500] == (500, 300, 0, round(29 / 31, 6)) and got[7] == (0, 300, 500, round(29 / 31, 6)) and got[501] == (501, 0, None, None)
    assert similarity.similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joins_are_by_equality(spark):
    plan = inspect.physical(similarity.similar(spark.createDataFrame(texts(1, 20), SCHEMA)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_common_grams_make_no_candidates(spark):
    """Texts of the same few words in different places share their grams, but are not joined on one of them."""
    words = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(40)]
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, " ".join(rng.sample(words, 8))) for i in range(600)], "key long, text string")
    signs = similarity.signatures(rows, 80).select("key", "sign", "whole")
    met = signs.join(signs.filter("whole").select(similarity.F.col("key").alias("other"), "sign"), "sign").filter("key < other").count()
    assert met < 600 * 599 / 2 / 50  # a gram is in a fifth of the texts, so all pairs share many


def test_each_pair_once_with_its_sizes(spark):
    rows = [(i, text) for i, text in enumerate(sorted({norm(t) for _, t in texts(3, 120) if t} - {""}))]
    got = sorted(tuple(r) for r in similarity.similar_pairs(spark.createDataFrame(rows, "key long, text string"), 60).select("a", "b", "shared", "whole").collect())
    sets = {i: grams(t) for i, t in rows}
    want = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    assert got == sorted(want)
