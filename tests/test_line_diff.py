"""Line differences: patches give the new text, hunks hold their context, summaries by a plain version."""

import random
import re

import pytest

from docspark.operators import line_diff

SCHEMA = "id long, old string, new string"


def ends(text):
    return [x for x in re.split("(?<=\n)", text or "") if x]


def apply(old, patch):
    """The new text from the old one and a unified patch."""
    if not patch:
        return old
    have, out, at, left = ends(old), [], 0, False
    for line in patch.split("\n")[2:]:
        if found := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@$", line):
            start = int(found[1]) - (found[2] != "0")
            out += have[at:start]
            at = start
            assert len(out) == int(found[3]) - (found[4] != "0")
        elif line.startswith("\\"):
            if left:
                out[-1] = out[-1][:-1]
        else:
            left = line[0] != "-"
            if left:
                out.append(line[1:] + "\n")
            if line[0] != "+":
                assert have[at].rstrip("\n") == line[1:]
                at += 1
    return "".join(out + have[at:])


def plain_summary(patch):
    """What the rules of a summary say, a line at a time."""
    bullets, table = [], [0, 0]

    def flush():
        if table != [0, 0]:
            bullets.append("Table updated: " + ", ".join(f"{n} rows {w}" for n, w in zip(table, ("added", "removed")) if n))
        table[:] = [0, 0]

    for line in patch.split("\n")[2:]:
        if re.match(r"@@|\\", line):
            continue
        text = line[1:].strip()
        if line[0] == " " or not text:
            flush()
        elif text.startswith("|"):
            table[line[0] == "-"] += 1
        else:
            flush()
            head = re.match(r"#{1,6}\s+(.+)$", text)
            bullets.append(f"Section '{head[1].strip()}' modified" if head else ("Added: " if line[0] == "+" else "Removed: ") + (text[:80] + "..." if len(text) > 80 else text))
    flush()
    short = [b for k, b in enumerate(bullets) if not k or bullets[k - 1] != b]
    return short if len(short) <= 20 else short[:19] + [f"... and {len(short) - 19} more changes"]


def versions(seed, n):
    rng = random.Random(seed)
    pool = ["", "# One", "## Two  ", "| a | b |", "| c |", "plain text", "other", "x" * 90, "  indented", "é\tü", "end", "same"]
    rows = []
    for i in range(n):
        old = [rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randrange(30)}" for _ in range(rng.randint(0, 60))]
        new = list(old)
        for _ in range(rng.choice([0, 1, 2, 8, 40])):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randint(0, 3)] = [rng.choice(pool) for _ in range(rng.randint(0, 3))]
        text = lambda x: "\n".join(x) + ("\n" if rng.random() < 0.6 and x else "")
        rows.append((i, text(old), text(new)))
    return rows


def test_patches_give_the_new_text(spark):
    rows = versions(4, 120) + [(500, None, None), (501, None, "a"), (502, "a\n", ""), (503, "a", "a\n"), (504, "b\na\n", "a\nb\n"), (505, "\n\n\n", "\n\n"), (None, "a", "b")]
    got = {r.id: r for r in line_diff.diff(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for i, old, new in rows:
        if i is None:
            continue
        r = got[i]
        assert apply(old or "", r.patch) == (new or ""), i
        body = [x for x in r.patch.split("\n")[2:] if x[:1] in "+-" and x]
        assert (r.added, r.removed) == (sum(x[0] == "+" for x in body), sum(x[0] == "-" for x in body)) and not r.patch_truncated
        assert r.summary == (plain_summary(r.patch) if r.patch else []), i
    assert got[502].patch == "--- previous\n+++ current\n@@ -1 +0,0 @@\n-a" and got[504].added == got[504].removed == 1


def test_matches_are_few_edits_and_hunks_hold_context(spark):
    old = "".join(f"line {k}\n" for k in range(100))
    new = old.replace("line 10\n", "").replace("line 50\n", "line 50\nnew\n").replace("line 55\n", "changed\n")
    rows = line_diff.in_hunks(line_diff.edits(spark.createDataFrame([(1, old, new)], SCHEMA)))
    got = [tuple(r)[1:8] for r in line_diff.hunks(rows).orderBy("hunk").collect()]
    assert got == [(1, 8, 7, 8, 6, 0, 1), (2, 49, 11, 48, 12, 2, 1)]


def test_large_patches_are_flagged_and_not_cut(spark):
    rows = [(1, "", "".join(f"a rather long line with the number {k}\n" for k in range(40_000))), (2, "a", "b")]
    got = {r.id: r for r in line_diff.diff(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].patch is None and got[1].patch_truncated and got[1].added == 40_000 and len(got[1].summary) == 20 and got[1].summary[-1] == "... and 39981 more changes"
    assert got[2].patch.endswith("-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file")
    assert line_diff.diff(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_run_in_order(seed):
    rng = random.Random(seed)
    pairs = [(i, rng.randrange(12)) for i in range(14)]
    best = max((sum(1 for _ in run) for run in _runs(pairs)), default=0)
    kept = line_diff.in_order(pairs)
    assert len(kept) == best and all(pairs[a][1] < pairs[b][1] for a, b in zip(kept, kept[1:]))
    assert line_diff.in_order([]) == []


def _runs(pairs):
    for mask in range(1 << len(pairs)):
        run = [p for k, p in enumerate(pairs) if mask >> k & 1]
        if all(a[1] < b[1] for a, b in zip(run, run[1:])):
            yield run
