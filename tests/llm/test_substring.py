"""Relative Lempel-Ziv parsing: ids with several texts, factors, long texts."""

import hashlib
import random

from docspark.llm import substring_dedup
from docspark.llm.substring_dedup import Parsing, factors

SPAN = 13


def passage(seed, n=30):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def removed(spark, rows, how=Parsing()):
    got = substring_dedup.parse(spark.createDataFrame(rows, "doc_id long, text string"), how)
    return {(r.doc_id, r.text): r.parsed.asDict(True) for r in got.collect()}


def brute(rows):
    """(removed words, kept words) by row: windows are judged against all texts with smaller ids."""
    out = {}
    for i, text in rows:
        w = text.split()
        seen = {tuple(v[j : j + SPAN]) for k, t in rows if k < i for v in [t.split()] for j in range(len(v) - SPAN + 1)}
        gone = {k for j in range(len(w) - SPAN + 1) if tuple(w[j : j + SPAN]) in seen for k in range(j, j + SPAN)}
        out[i, text] = len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_ids_with_several_texts(spark):
    a, u = passage(1), passage(2)
    rows = [(3, a), (7, u), (7, a), (9, u)]
    got = removed(spark, rows)
    assert {k: v["n_removed"] for k, v in got.items()} == {(3, a): 0, (7, u): 0, (7, a): 30, (9, u): 30}


def test_families_against_brute_force(spark):
    rng = random.Random(8)
    pool = [passage(k, rng.choice([12, 13, 14, 40, 90])) for k in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice([rng.choice(pool), passage(1000 + 10 * i + k, rng.randint(1, 9)), "the the the the"]) for k in range(rng.randint(1, 7))]
        rows.append((rng.randrange(70), " ".join(parts)))
    rows = list(dict.fromkeys(rows))
    want = brute(rows)
    for how in (Parsing(), Parsing(block=16, hot=2)):
        got = removed(spark, rows, how)
        assert {k: (v["n_removed"], v["kept_sha256"]) for k, v in got.items()} == {k: (n, hashlib.sha256(rest.encode()).hexdigest()) for k, (n, rest) in want.items()}
    assert sum(n for n, _ in want.values()) > 2000
    words = {i: [t.split() for k, t in rows if k == i] for i, _ in rows}
    for (i, text), v in got.items():
        for f in v["factors"]:
            own = text.split()[f["start"] : f["start"] + f["length"]]
            at = f["place"] & (2**31 - 1)
            assert f["source"] < i and f["length"] >= SPAN and any(w[at : at + f["length"]] == own for w in words[f["source"]])


def test_greedy_factors_and_collisions():
    how = Parsing(span=3, block=4)
    theirs = "a b c d e f g h i j".encode().split()
    blocks = {(5, p): theirs[p : p + 4] for p in range(0, len(theirs), 4)}
    ours = "x c d e f g z d e f".encode().split()
    assert factors(ours, [1, 2, 3, 7], [(5, 2), (5, 3), (5, 4), (5, 3)], blocks, how) == [(1, 5, 5, 2), (7, 3, 5, 3)]
    assert factors(ours, [0, 1], [(5, 6), (5, 2)], blocks, how) == [(1, 5, 5, 2)]  # the first hit is another window of the same hash
    # a window over the border of a factor has a source of its own
    other = {(6, 0): b"f g z q".split()}
    assert factors(ours, [1, 2, 3, 4], [(5, 2), (5, 3), (5, 4), (6, 0)], blocks | other, how) == [(1, 5, 5, 2), (4, 3, 6, 0)]
    assert factors(ours, [], [], {}, how) == []


def test_text_beyond_a_chunk(spark):
    shared = passage(3, 60)
    long = " ".join(f"l{k}" for k in range(200_000)) + " " + shared
    assert len(long) > 1 << 20
    got = removed(spark, [(1, long), (2, "before " + shared + " after"), (3, long + " end"), (4, None or "")])
    assert got[2, "before " + shared + " after"]["n_removed"] == 60
    assert got[3, long + " end"]["n_removed"] == 200_060 and got[1, long]["n_removed"] == 0
