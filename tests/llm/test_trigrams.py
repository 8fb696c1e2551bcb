"""Order three of the language model against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from test_ops import SCHEMA, corpus

from docspark.llm import lm_scoring


@pytest.mark.parametrize("least", [1, 2, 3])
def test_order_three(spark, put, monkeypatch, least):
    rows = corpus()
    monkeypatch.setattr(lm_scoring, "LEAST_TRIPLE", least)
    got = {r.doc_id: r for r in lm_scoring.op8_lm_scoring(spark, put(rows, SCHEMA)).collect()}
    tokens = {r[0]: [w.lower() for w in (r[1] or "").encode().split()] + [None] for r in rows}
    learn = [i for i in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    vocabulary = {w for i in learn for w in tokens[i]}
    three = lambda own: zip(["<b>", "<b>", *own[:-2]] if len(own) > 1 else ["<b>"], ["<b>", *own[:-1]], own)
    triples = Counter(x for i in learn for x in three(tokens[i]))
    behind = Counter((v, w) for _, v, w in triples)
    before = Counter(w for _, w in behind)
    after3, after2 = defaultdict(list), defaultdict(list)
    for (u, v, _), n in triples.items():
        after3[u, v].append(n)
    for (v, _), n in behind.items():
        after2[v].append(n)
    d3, d2, d1 = (lm_scoring._discounts([sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]) for x in (triples, behind, before))

    d3 = tuple(k if k < least else d for k, d in zip((1, 2, 3), d3))

    def mixed(n, after, d, lower):
        return ((max(n - d[min(n, 3) - 1], 0) if n else 0) + sum(d[min(x, 3) - 1] for x in after) * lower) / sum(after) if after else lower

    def p(u, v, w):
        spare = sum(d1[min(n, 3) - 1] for n in before.values()) / len(behind) / (len(vocabulary) + 1)
        lower = spare + (max(before[w] - d1[min(before[w], 3) - 1], 0) / len(behind) if before[w] else 0)
        return mixed(triples[u, v, w], after3.get((u, v)), d3, mixed(behind[v, w], after2.get(v), d2, lower))

    for i, own in tokens.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(*x)) for x in three(own)), rel=1e-12)
    for u, v in (("<b>", "<b>"), ("<b>", tokens[1][0]), tuple(tokens[1][:2]), ("<unknown>", tokens[1][0])):
        assert sum(p(u, v, w) for w in [*vocabulary, "<unknown>"]) == pytest.approx(1)
    assert got[1].score != got[1].score2


def test_keys_stay_small_at_any_size():
    import numpy as np

    sizes = np.full(1 << 10, 1 << 27, np.int64)  # 2 ** 37 bigrams, and 2 ** 30 words: 67 bits as one number
    model = lm_scoring.Model("", 4, np.array([(1 << 30) - 1]), 10, sizes, 1, (0.5, 1.0, 1.5), 1.0, (1.0, 1.0))
    assert model.pairs.bit_length() + model.word_bits > 64
    context = np.array([0, (1 << 27) - 1, 1 << 27, (1 << 37) - 1, 1 << 37])
    part, keys = lm_scoring._triple_keys(context, np.array([5, 0, (1 << 30) - 2, 1, 7]), model)
    assert part.tolist() == [0, 0, 1, 1023, 1023]
    assert [int(k) >> 30 for k in keys] == [0, (1 << 27) - 1, 0, (1 << 27) - 1, 1 << 27] and [int(k) & ((1 << 30) - 1) for k in keys] == [5, 0, (1 << 30) - 2, 1, 7]
    for top in (9, (1 << 63) + 9, (1 << 64) - 1):  # in one number, or not
        parts, own = np.array([1, 0, 1, 0]), np.array([3, top, 3, 2], np.uint64)
        part, keys, inverse = lm_scoring._distinct(parts, own, inverse=True)
        assert list(zip(part.tolist(), keys.tolist())) == [(0, 2), (0, top), (1, 3)] and inverse.tolist() == [2, 1, 2, 0]
        assert lm_scoring._distinct(parts, own, inverse=False)[2].tolist() == [1, 1, 2]
        part, keys, n = lm_scoring._distinct(np.zeros(3, np.int64), np.array([top, 0, top], np.uint64), inverse=False)
        assert (part.tolist(), keys.tolist(), n.tolist()) == ([0, 0], [0, top], [1, 2])
