"""The template tree against a brute-force version."""

import random
from collections import Counter, defaultdict

from docspark.llm import line_dedup
from docspark.llm.line_dedup import Templates

SCHEMA = "doc_id long, text string"


def drops(spark, rows, how=Templates()):
    got = line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA), how).collect()
    return {r.doc_id: (bytes(r.lines.text).decode() if r.lines.text is not None else None, r.lines.n_dropped) for r in got}


def brute(rows, how):
    """What the rules of the module say, one line at a time."""

    def shape(line):
        plain = line.split()
        masked = [None if any(c in "0123456789" for c in t) else t for t in plain]
        return tuple(masked) if 2 * masked.count(None) <= len(plain) else ("plain", *plain)

    lines = defaultdict(set)  # shape -> documents
    for i, text in rows:
        for line in (text or "").split("\n"):
            if line.split():
                lines[shape(line)].add(i)
    general = {s for s in lines if s[:1] != ("plain",) and len(s) > how.least_fixed}
    counts = Counter()
    for s in general:
        for k, t in enumerate(s):
            counts[len(s), s[0], k, t] += len(lines[s])
    template = {}
    for s in general:
        told = tuple(t if counts[len(s), s[0], k, t] >= how.least_docs else "*" for k, t in enumerate(s))
        fixed = sum(t not in ("*", None) for t in told)
        run = max((len(x) for x in "".join("*" if t == "*" else " " for t in told).split()), default=0)
        if run and fixed >= max(how.least_fixed, how.least_share * len(s)) and run <= how.longest_field:
            template[s] = told
    docs = defaultdict(set)
    for s, t in template.items():
        docs[t] |= lines[s]
    out = {}
    for i, text in rows:
        kept, n = [], 0
        for line in (text or "").split("\n"):
            s = shape(line) if line.split() else None
            size = len(s) - (s[:1] == ("plain",)) if s else 0
            least = how.least_docs if size >= how.least_tokens else how.short_docs
            gone = bool(s) and len(lines[s]) >= least and i > min(lines[s])
            t = template.get(s)
            gone |= t is not None and len(docs[t]) >= how.least_docs and i > min(docs[t])
            n += gone
            if not gone:
                kept.append(line)
        out[i] = n
    return out


def test_templates_of_both_families(spark):
    word = lambda k: "".join(random.Random(k).choice("abcdefghij") for _ in range(9))
    rows = []
    for i in range(12):
        x, y, z, w = (word(100 * i + j) for j in range(4))
        alike = " ".join(["these nine first words of a line are equal", *(word(5000 + 10 * i + j) for j in range(8))])
        rows.append((i, f"{alike}\nuser {x} opened file {y} from host {z} at port {w}\nPosted by {x} in category {y} today\nown {x} {y}"))
    got = drops(spark, rows)
    for i, (text, n) in got.items():
        assert n == (2 if i else 0) and "these nine" in text and "own" in text
        assert ("opened file" in text) == (i == 0) == ("Posted by" in text)


def test_against_brute_force_and_in_both_ways(spark):
    rng = random.Random(6)
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "sa", "ta", "va")]
    frames_ = ["user {} opened file {} from host {} at port {}", "the {} of the {} was in the {} again today", "Posted by {} in {} today again", "error 17 at line {} of the module {}", "{} 12 33 44", "Page {}", "ok"]
    rows = []
    for i in range(240):
        own = []
        for _ in range(rng.randint(1, 6)):
            f = rng.choice(frames_)
            own.append(f.format(*(rng.choice(names) if rng.random() < 0.4 else f"q{''.join(rng.choice('abcdefg') for _ in range(6))}" for _ in range(4))))
        own.append(" ".join(rng.choice(names) for _ in range(rng.randint(3, 12))))
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(1000, ""), (1001, " \n\n "), (1002, None)]
    how = Templates(short_docs=60)
    want = brute(rows, how)
    got = drops(spark, rows, how)
    assert {i: n for i, (_, n) in got.items()} == want and sum(want.values()) > 300
    assert drops(spark, rows, Templates(short_docs=60, leaf_rows=5)) == got
    assert got[1000] == ("", 0) and got[1001] == (" \n\n ", 0) and got[1002] == (None, 0)


def test_repeated_rows_count_once(spark):
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven"]
    line = "alpha beta gamma delta {} epsilon zeta eta"
    rows = [(i, line.format(x)) for i, x in enumerate(names)] + [(5, line.format("five"))] * 12
    rows += [(40 + i, f"only {x} words here of nine again in it") for i, x in enumerate(names[:9])] + [(40, f"only {x} words here of nine again in it") for x in names]
    want = brute(rows, Templates())
    for how in (Templates(), Templates(leaf_rows=5)):
        got = line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA).repartition(3), how).collect()
        assert sorted((r.doc_id, r.lines.n_dropped) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert want[5] == 1 and want[0] == 0 and want[41] == 0  # nine documents aren't ten


def test_a_long_text(spark):
    rows = [(i, "\n".join(f"entry {i} {k} of the same long list of lines" for k in range(60_000 if i == 3 else 2))) for i in range(12)]
    got = drops(spark, rows)
    assert len(rows[3][1]) > 2 << 20 and got[3][1] == 60_000 and got[0][1] == 0 and all(got[i][1] == 2 for i in range(1, 12) if i != 3)
