"""The ten operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.llm import bpe, embedding_dedup, graph, line_dedup, lm_scoring, minhash_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, token_counts
from docspark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchors string"


def corpus(seed=3, n=160):
    """Texts with copies, near copies, shared passages, repeated words, odd white space, long ones, empty ones and nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "ß"]) for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n"]) for _ in range(k))
    passage, boiler = text(40), "released under some licence version 7 today"
    texts = [text(rng.randint(1, 260)) for _ in range(n)]
    for i in range(5, n, 7):
        base = texts[rng.randrange(i)].split(" ")
        for _ in range(max(1, len(base) // 40)):
            base[rng.randrange(len(base))] = word()
        texts[i] = " ".join(base)
    for i in range(3, n, 11):
        texts[i] = texts[i] + "\n" + passage + "\n" + boiler.replace("7", str(i))
    for i in range(2, n, 9):
        texts[i] = texts[2]
    texts += ["", "   \n\t ", None, "a", "A", "a b", "the the the " * 60, text(6000), "x\x1c y z <|endoftext|> 日本 🙂", "\n\n \n", "###$$ " * 80]
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], "s" if i % 3 else None, len(t or ""), f"x{i}") for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "en", "s", 1, "null id")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def folder(put, rows):
    f = put(rows, SCHEMA)
    put([(r[0], int(i % 4 != 0), 0) for i, r in enumerate(rows) if r[0]], "doc_id long, quality int, toxic int", "labels", f)
    return f


@pytest.fixture(scope="module")
def nothing(put):
    f = put([], SCHEMA)
    put([], "doc_id long, quality int, toxic int", "labels", f)
    put([], "vec_id long, embedding array<float>, label int", "embeddings", f)
    put([], "page_id long, url string, html string", "pages", f)
    return f


def words(text):
    return (text or "").encode().split()


def by_id(spark, name, folder):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_substring(spark, rows, folder):
    found, seen = by_id(spark, "op3_substring_dedup", folder), set()
    for i, text in sorted((r[0], r[1]) for r in rows if r[0]):
        w = words(text)
        grams = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {k for j, g in enumerate(grams) if g in seen for k in range(j, j + 13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
        seen.update(grams)
    assert sum(r.n_removed for r in found.values()) > 500 and found[None].n_removed == 0


def test_substring_hot_path_is_the_same(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (substring_dedup.parse(docs, substring_dedup.Parsing(hot=h)).select("doc_id", "parsed.n_removed", "parsed.kept_sha256").collect() for h in (2, 10**9))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_substring_stage(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in substring_dedup.substring_dedup_stage(spark, docs, "").collect()}
    kept = {r.doc_id: r.kept_sha256 for r in substring_dedup.parse(docs).select("doc_id", "parsed.kept_sha256").collect()}
    assert len(out) == len(rows)
    for i, r in out.items():
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == kept[i] and r.n_chars == (len(r.text) if r.text is not None else None)


def test_minhash(spark, rows, folder):
    found = by_id(spark, "op9_minhash_dedup", folder)
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets[r[0]] = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = union(links, ids)
    assert len(links) > 100
    for i in ids:
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), component[i], component[i] == i)
    assert found[None].kept and found[None].component_id is None


def test_minhash_family_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(4, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.TWO_WORDS).collect()}
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for _, t in rows]
    links = [(a, b) for a in range(700) for b in range(a + 1, 700) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert found == union(links, range(700))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    for small in (1, 2, 7):
        assert (minhash_dedup.sketches(a[:small], np.array([small]), 160) < np.iinfo(np.uint64).max).all()
    x, y = minhash_dedup.sketches(np.concatenate([a, b]), np.array([400, 400]), 2000)
    assert abs((x == y).mean() - 300 / 500) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = union(edges, nodes)
    assert found == {n: want[n] for n in found} and {n for n in nodes if want[n] != n} <= set(found)


def test_quality_rules(spark, rows, folder):
    found = by_id(spark, "op4_quality_rules", folder)
    for r in rows:
        w, got = words(r[1]), found[r[0]]
        text = r[1] or ""
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        base = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert got.base_failed == failed and not (failed and got.kept)


def test_jensen_shannon(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.5, 0.5]), ([1.0], None)], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    want = math.sqrt((kl((0.9, 0.1), (0.7, 0.3)) + kl((0.5, 0.5), (0.7, 0.3))) / 2)
    assert got[:2] == [1.0, 0.0] and got[2] == pytest.approx(want) and got[3] == 1.0


def test_packing(spark, rows, folder):
    got = packing.op7_packing(spark, folder).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(own.tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r["offset"], r.length))
    for i, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) == len(ids[i])
    assert set(pieces) == set(ids)
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= packing.MAX_TOKENS
    assert sorted(sequences) == list(range(len(sequences)))


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({5: 3, 4: 2, 3: 4, 1: 7}, 8)
    used = Counter(x for n, lengths in patterns for x in lengths for _ in range(n))
    assert used == {5: 3, 4: 2, 3: 4, 1: 7} and all(sum(lengths) <= 8 for _, lengths in patterns)
    assert packing.shortest_pack_first({}, 8) == []


def test_ids_are_the_tokenizers(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    texts = [r[1] for r in rows] + ["a  b", "　x  y", " \n \t z", "don't  we'll 12 345 ##", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x  <|endoftext|>", "<|endoftext|", "<|endof", "text|>"]
    ids, counts = bpe.encode(pa.array(texts), bpe.default_path())
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_lm(spark, rows, folder):
    got = by_id(spark, "op8_lm_scoring", folder)
    tokens = {r[0]: [w.lower() for w in words(r[1])] + [None] for r in rows}
    learn = [i for i in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in learn for w in tokens[i])
    total, size = sum(count.values()), len(count)
    pairs = Counter(p for i in learn for p in zip(["<begin>", *tokens[i][:-1]], tokens[i]))
    after, before = defaultdict(list), Counter()
    for (v, w), n in pairs.items():
        after[v].append(n)
        before[w] += 1
    d, low = (lm_scoring._discounts([sum(n == k for n in x) for k in (1, 2, 3, 4)]) for x in (pairs.values(), before.values()))
    spare = sum(low[min(n, 3) - 1] for n in before.values()) / len(pairs)

    def p(v, w):
        lower = spare / (size + 1) + (max(before[w] - low[min(before[w], 3) - 1], 0) / len(pairs) if before[w] else 0)
        if v not in after:
            return lower
        n, all_ = pairs.get((v, w), 0), sum(after[v])
        return (max(n - d[min(n, 3) - 1], 0) / all_ if n else 0) + sum(d[min(x, 3) - 1] for x in after[v]) / all_ * lower

    for i, own in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (size + 1))) for w in own)
        score = sum(math.log10(p(v, w)) for v, w in zip(["<begin>", *own[:-1]], own))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), total)
        assert r.base_score == pytest.approx(base) and r.score2 == pytest.approx(score)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    vocabulary = [*count, "<unknown>"]
    for v in ("<begin>", tokens[1][0], "<unknown>"):
        assert sum(p(v, w) for w in vocabulary) == pytest.approx(1)


def test_unmix():
    x = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (lm_scoring.unmix64(lm_scoring.mix64(x)) == x).all()


def test_classifier(spark, rows, folder):
    got = by_id(spark, "op2_quality_classifier", folder)
    assert set(got) == {r[0] for r in rows} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    rng = random.Random(1)
    junk = lambda: " ".join(rng.choice(["ab", "cd", "ef"]) + rng.choice(["###", "$$"]) for _ in range(50))
    fine = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(50))
    texts = [f() for _ in range(150) for f in (junk, fine)]
    labels = np.array([0, 1] * 150)
    model = quality_classifier.train(pa.array(texts[:200]).cast(pa.binary()), labels[:200], quality_classifier.Training())
    held = quality_classifier.scores(pa.array(texts[200:]).cast(pa.binary()), model)
    assert ((held >= 0.3) == labels[200:]).mean() > 0.97
    one = quality_classifier.train(pa.array([b"a"]), np.array([1]), quality_classifier.Training())
    assert quality_classifier.scores(pa.array([b"", b"x"]), one).min() > 0.9


def test_sentencepiece(spark, rows, folder):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(sentencepiece_codec.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the library's own Viterbi over the same scores
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    a, _ = sentencepiece_codec.loaded(sentencepiece_codec.default_path())
    texts = [(r[1] or "")[:60] for r in rows[:80]] + ["日本語 text", "🙂 x", "  a  b\n", "ünï"]
    ids, counts = sentencepiece_codec.encode_column(pa.array(texts), sentencepiece_codec.default_path())
    total = lambda x: sum(a.score[i] if a.length[i] else -1e6 for i in x)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        best = library.nbest_encode(text, nbest_size=1)[0] if text else []
        assert total(own.tolist()) >= total(best) - 1e-6
    decoded = sentencepiece_codec.decode_ids(ids, counts, sentencepiece_codec.default_path()).to_pylist()
    assert [d.decode() for d in decoded] == texts
    assert all(r.round_trip for r in by_id(spark, "op5_sentencepiece", folder).values())
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(spark.createDataFrame(rows[:20], SCHEMA)))
    assert all(r.decoded == r.text for r in both.collect())


def test_viterbi_is_best_by_brute_force():
    pieces = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba", b"bab"]
    scores = [-3.0, -2.0, -2.5, -3.0, -3.9, -4.0, -5.5, -4.1]
    a = sentencepiece_codec.build(pieces, list(range(8)), scores, np.full(256, 99), pieces)

    def best(s):
        return 0.0 if not s else max((scores[i] + best(s[len(p) :]) for i, p in enumerate(pieces) if s.startswith(p)), default=-1e9)

    rng = random.Random(4)
    spans = [b" " + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 11))) for _ in range(200)]
    for s, ids in zip(spans, sentencepiece_codec.viterbi(spans, a)):
        assert b"".join(pieces[i] for i in ids) == s and sum(scores[i] for i in ids) == pytest.approx(best(s))


def test_embeddings(spark, put):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(900):
        v = centres[i % 40] + rng.standard_normal(16) * (0.12 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v], int(i % 2) if i % 50 else None))
    rows += [(1000 + k, rows[1][1], rows[1][2]) for k in range(5)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, [1.0] * 5, 1), (2006, [1.0] * 5, 1), (2007, [float("inf")] * 16, 0)]
    folder = put(rows, "vec_id long, embedding array<double>, label int", "embeddings")
    got = {r.vec_id: r for r in embedding_dedup.op6_embedding_dedup(spark, folder).collect()}
    ok = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for i, v, l in ok:
        for j, w, m in ok:
            if i < j and l == m and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    component = union([(i, j) for i in links for j in links[i]], [r[0] for r in rows])
    recall = sum(r.n_links for r in got.values()) / sum(map(len, links.values()))
    assert 0.97 <= recall <= 1 and sum(map(len, links.values())) > 1000
    assert all(r.n_links <= len(links[i]) for i, r in got.items())
    assert sum(r.component_id != component[i] for i, r in got.items()) <= 5
    assert got[2005].n_links == 1 and all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2007))
    small = embedding_dedup.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), embedding_dedup.Forest(leaf_rows=60, block_rows=30))
    assert sum(r.n_links for r in small.collect()) >= 0.97 * sum(map(len, links.values()))
    # levels beyond the first round, fitted by node in Spark
    deep = embedding_dedup.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), embedding_dedup.Forest(leaf_rows=20, fitted_levels=2, node_rows=100))
    deep = {r.vec_id: r for r in deep.collect()}
    assert sum(r.n_links for r in deep.values()) >= 0.97 * sum(map(len, links.values())) and all(r.n_links <= len(links[i]) for i, r in deep.items())
    assert embedding_dedup.Forest().trees_for(6) == 14 < embedding_dedup.Forest().trees_for(12) < embedding_dedup.Forest().trees_for(12, 0.7)


def test_embeddings_of_two_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        width = 8 if i % 3 else 12
        v = np.repeat([1.0, 2.0, -1.0, 0.5], width // 4) * (1 if i % 2 else -1) + rng.standard_normal(width) * 0.2
        rows.append((i, [float(x) for x in v], 1))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), embedding_dedup.Forest(leaf_rows=40)).collect()}
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for _, v, _ in rows]
    want = {i: sum(len(u) == len(w) and i != j and u @ w >= 0.93 for j, w in enumerate(unit)) for i, u in enumerate(unit)}
    assert sum(want.values()) > 1000 and sum(got.values()) >= 0.97 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_lines(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).select("doc_id", "lines.*").collect()}
    text = {r[0]: r[1] for r in rows}
    boiler = [i for i, t in text.items() if i and t and "released under some licence" in t]
    first = min(boiler)
    assert len(boiler) >= 10
    for i in boiler:
        assert (b"released under" in got[i].text) == (i == first)
    alone = [i for i, t in text.items() if t and Counter(text.values())[t] == 1 and i not in boiler]
    assert all(got[i].text == text[i].encode() for i in alone if got[i].n_dropped == 0) and sum(got[i].n_dropped for i in alone) < 5
    assert got[None].n_dropped == 0 and got[None].text == text[None].encode()
    stage = line_dedup.line_dedup_stage(spark, docs, "")
    assert stage.columns == docs.columns and stage.count() == len(rows)


def test_token_ledger(spark, rows, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    docs = spark.createDataFrame([r for r in rows if r[0]], SCHEMA)
    tag = lambda df, op: df.withColumn("op", F.lit(op))
    assert ledger.apply("one", tag(docs, "insert")) and not ledger.apply("one", tag(docs, "insert"))

    def want(texts):
        out = Counter()
        for source, lang, t in texts:
            _, n = bpe.encode(pa.array([t], pa.string()), bpe.default_path())
            for key, k in (("byte_bpe_50k-1", int(n[0])), ("words-1", len(words(t)))):
                out[source, lang, key, "docs"] += 1
                out[source, lang, key, "tokens"] += k
        return {k: v for k, v in out.items() if v}

    def have():
        return {(r.source, r.lang, r.tokenizer, k): v for r in ledger.totals().collect() for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens)) if v}

    live = {r[0]: (r[3], r[2], r[1]) for r in rows if r[0]}
    assert have() == want(live.values())
    gone = docs.filter("doc_id % 2 = 0")
    ledger.apply("two", tag(gone, "delete"))
    live = {i: v for i, v in live.items() if i % 2}
    old = docs.filter("doc_id % 5 = 1 and doc_id % 2 = 1")
    ledger.revise("three", old, old.withColumn("text", F.lit("new text here")))
    ledger.revise("three", old, old.withColumn("text", F.lit("never")))
    live = {i: (v[0], v[1], "new text here") if i % 5 == 1 else v for i, v in live.items()}
    assert have() == want(live.values())
    with pytest.raises(Exception, match="unknown op"):
        ledger.apply("four", tag(docs, "merge"))
    assert have() == want(live.values())
    # a compaction changes no total and forgets no name, twice over; one that broke off is ignored
    assert ledger.compact() and not ledger.compact()
    assert have() == want(live.values()) and ledger.committed("one") and not ledger.apply("two", tag(gone, "delete"))
    ledger.apply("five", tag(docs.filter("doc_id = 1").withColumn("text", F.lit("new text here")), "delete"))
    spark.createDataFrame([("x", "y", "z", 1, 1)], "source string, lang string, tokenizer string, docs bigint, tokens bigint").write.parquet(f"{ledger.folder}/base=9/deltas")
    live.pop(1)
    assert have() == want(live.values())
    assert ledger.compact() and have() == want(live.values()) and ledger.committed("five") and ledger.committed("three") and not ledger.committed("six")


def test_oracles_name_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark, rows, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns, name
        path = f"{folder}/{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}
