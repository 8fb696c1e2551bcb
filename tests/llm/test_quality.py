"""Quality rules and classifier against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_ops import SCHEMA, corpus

from docspark.llm import quality_classifier, quality_rules
from docspark.llm.quality_rules import CLASSES, COMMON_WORDS, SYMBOLS, Rules

MASK = (1 << 64) - 1


def class_of(b):
    if b < 32 or b == 127:
        return "blank" if b == 9 else "newline" if b in (10, 11, 12, 13) else "control"
    c = chr(b)
    if b >= 128:
        return "beyond_ascii"
    if c.isalpha():
        return "lower" if c.islower() else "upper"
    return "digit" if c.isdigit() else "blank" if c == " " else "symbol" if c in SYMBOLS else "stop" if c in ".,;:!?\'\"()-" else "other"


def shares(counts, keys):
    total = sum(counts.values()) or 1
    return [counts[k] / total for k in keys]


def distance(p, q):
    term = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(sum(term(x, (x + y) / 2) + term(y, (x + y) / 2) for x, y in zip(p, q)) / 2, 0))


@pytest.mark.parametrize("rules", [Rules(), Rules(char_distance=0.02, char_noise=0.1, word_distance=0.02, word_noise=0.3, min_chars=400, min_words=60), Rules(least_words=3, min_chars=10**6, min_words=10**6)])
def test_verdict_from_histograms_and_references(spark, rules):
    rows = corpus()
    common = sorted(set(COMMON_WORDS.split()))
    shapes, by_lang = {}, defaultdict(list)
    for k, (_, text, lang, *_rest) in enumerate(rows):
        data = (text or "").encode()
        words = [w.decode() for w in data.split()]
        classes = shares(Counter(map(class_of, data)), CLASSES)
        named = Counter(w if w in common else None for w in words)
        shapes[k] = classes, shares(named, [*common, None]), words
        if data:
            by_lang[lang].append(shapes[k][:2])
    mean = lambda parts: [sum(x) / sum(map(sum, parts)) for x in zip(*parts)]
    refs = {lang: tuple(mean([p[i] for p in parts]) for i in (0, 1)) for lang, parts in by_lang.items()}
    tagged = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", k int")
    got = {r.k: r.quality for r in quality_rules.judge(tagged, rules).collect()}
    verdicts = Counter()
    for k, (classes, named, words) in shapes.items():
        n, grams = len(words), Counter(zip(words, words[1:], words[2:]))
        covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(i, i + 3)}
        failed = n < rules.least_words or 100 * len(covered) > rules.most_repeat_percent * n
        chars, common_words = distance(classes, refs[rows[k][2]][0]), distance(named, refs[rows[k][2]][1])
        limit = lambda base, noise: base + noise / math.sqrt(max(n, 1))
        far = sum(map(len, words)) >= rules.min_chars and chars > limit(rules.char_distance, rules.char_noise)
        far = far or n >= rules.min_words and common_words > limit(rules.word_distance, rules.word_noise)
        assert got[k].char_distance == pytest.approx(chars, abs=1e-9) and got[k].word_distance == pytest.approx(common_words, abs=1e-9)
        assert (got[k].base_failed, got[k].kept) == (failed, not failed and not far)
        verdicts[failed, far] += 1
    assert len(verdicts) > 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def test_features_by_brute_force():
    texts = ["ab  cd\nab ab", "", "x", "é ß", "one two three " * 5]
    column = pa.array(texts).cast(pa.binary())
    got = quality_classifier.document_buckets(column, (2, 3))
    shift = 64 - quality_classifier.BUCKET_BITS
    for text, own in zip(texts, got):
        data, want = text.encode(), []
        hashes = [int(quality_classifier.Words(pa.array([w])).hashes(2)[0]) for w in data.split()]
        want += [h >> shift for h in hashes] + [mixed(a ^ b) >> shift for a, b in zip(hashes, hashes[1:])]
        for n in (2, 3):
            for i in range(len(data) - n + 1):
                want.append(mixed((n << 8 * n) + int.from_bytes(data[i : i + n], "big")) >> shift)
        assert sorted(own.tolist()) == sorted(want)


def test_a_step_is_the_gradient():
    rng = np.random.default_rng(2)
    vectors, weights, bias = rng.standard_normal((6, 4)), rng.standard_normal((4, 2)), rng.standard_normal(2)
    buckets, share, label, rate = np.array([1, 4, 5]), np.array([[0.5], [0.3], [0.01]]), 1, 0.1

    def loss(mean, w, b):
        z = mean @ w + b
        return float(np.log(np.exp(z).sum()) - z[label])

    mean = (vectors[buckets] * share).sum(0)

    def numeric(f, x):
        out = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            out[i] = (f(up) - f(down)) / 2e-6
        return out

    by_mean, by_weights, by_bias = numeric(lambda m: loss(m, weights, bias), mean), numeric(lambda w: loss(mean, w, bias), weights), numeric(lambda b: loss(mean, weights, b), bias)
    v, w, b = vectors.copy(), weights.copy(), bias.copy()
    seen = np.full((6, 1), 0.5)
    quality_classifier.descend(v, w, b, seen, buckets, share, label, rate)
    assert np.allclose(w, weights - rate * by_weights, atol=1e-6) and np.allclose(b, bias - 0.1 * rate * by_bias, atol=1e-6)
    by_vector = numeric(lambda x: loss((x * share).sum(0), weights, bias), vectors[buckets])
    assert np.allclose(by_vector, share * by_mean, atol=1e-6)
    assert np.allclose(seen[buckets], 0.5 + (by_vector**2).mean(1, keepdims=True), atol=1e-6) and (seen[[0, 2, 3]] == 0.5).all()
    assert np.allclose(v[buckets], vectors[buckets] - quality_classifier.VECTOR_RATE * rate * by_vector / np.sqrt(seen[buckets]), atol=1e-6) and (v[[0, 2, 3]] == vectors[[0, 2, 3]]).all()


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(i, "other") for i in range(2, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, 1)] * 5, "doc_id long, quality int")
    for most in (2, 4, 100):
        rows = quality_classifier.training_rows(docs, labels, quality_classifier.Training(most_rows=most)).collect()
        assert len(rows) <= most and rows


def test_held_out_is_never_null(spark, put):
    f = put([(1, "some text"), (None, "other"), (2, None)], "doc_id long, text string")
    put([(1, 1, 0)], "doc_id long, quality int, toxic int", "labels", f)
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in quality_classifier.op2_quality_classifier(spark, f).collect())
