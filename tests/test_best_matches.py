"""The best match by matching blocks against difflib."""

import difflib
import random

from docspark.operators import joins


def plain(elements, stored, least):
    out = []
    for i, text in enumerate(elements):
        ratios = [difflib.SequenceMatcher(None, text, other).ratio() for other in stored]
        j = max(range(len(stored)), key=lambda j: (ratios[j], -j), default=-1)
        if text and j >= 0 and ratios[j] >= least and ratios[j] > 0:
            out.append((i, j, ratios[j]))
    return out


def texts(seed, n, letters, longest):
    rng = random.Random(seed)
    out = [""]
    for _ in range(n):
        text = list(rng.choice(out) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(0, longest))))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 3)] = rng.choice(["", "x", "teh", letters])
        out.append("".join(text))
    return out


def test_equals_difflib():
    """Short texts, and long ones with frequent letters, which difflib treats apart from 200 letters on."""
    for seed, letters, longest in ((1, "ab", 30), (2, "abcdefgh ", 60), (3, "abcdefghijklmnopqrstuvwxyz  ", 700), (4, "".join(map(chr, range(97, 400))), 500), (5, "a", 260)):
        stored, elements = texts(seed, 25, letters, longest), texts(seed + 10, 25, letters, longest) + texts(seed, 10, letters, longest)
        for a in elements:
            for b in stored:
                assert joins._Entry(b).ratio(a) == difflib.SequenceMatcher(None, a, b).ratio()
        for least in (0.3, 0.9):
            assert joins.best_matches(elements, stored, least) == plain(elements, stored, least)


def test_few_steps_for_a_long_line(monkeypatch):
    """difflib looks at each letter in each of the recursion's rounds; here only at those that a match may start from."""
    calls = []
    alike = joins._alike
    monkeypatch.setattr(joins, "_alike", lambda *a, **b: calls.append(1) or alike(*a, **b))
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", None)
    rng = random.Random(1)
    line = " ".join("the" if k % 9 == 0 else "".join(rng.choices([chr(97 + x) for x in range(300)], k=5)) for k in range(100))
    assert joins.best_matches([line.replace("the", "teh", 3)], [line], 0.9)[0][1] == 0 and len(calls) < 100
