"""URL filters, ball k-means and the filter audit against brute force, and their edge cases."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import ball_kmeans, filter_audit, url_filters
from docspark.llm.ball_kmeans import Clustering
from docspark.llm.queries import QUERIES
from docspark.llm.url_filters import ALLOW, BLOCK, RULES, Spread

PAGES = "page_id long, url string, html string"
RULE = "host string, path string, verdict string"


def split_url(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (found[1].translate(lower), found[2]) if found else ("", "")


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == BLOCK)) if fits else None


def brute_judge(pages, rules, how):
    at = [(split_url(u), h) for _, u, h in pages]
    ruled = [brute_rule(h, p, rules) for (h, p), _ in at]
    of, edges = {}, {}
    for ((host, _), html), r in zip(at, ruled):
        if not host:
            continue
        mine = of.setdefault(host, [0, 0, 0])
        mine[0] += 1
        mine[1] += r is not None and r[2] == ALLOW
        mine[2] += r is not None and r[2] == BLOCK
        for link in re.findall(r"""href="([^"]*)\"""", html or ""):
            found = re.match(r"(?:[a-z]+:)?//([^/?#]*)", link)
            if found and found[1].lower() not in ("", host):
                edges[host, found[1].lower()] = edges.get((host, found[1].lower()), 0) + 1

    def ranks(edges, seeds):
        total, wave = dict(seeds), dict(seeds)
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        for _ in range(how.rounds):
            nxt = {}
            for (a, b), n in edges.items():
                if a in wave:
                    nxt[b] = nxt.get(b, 0) + how.damping * wave[a] * n / out[a]
            wave = nxt
            for b, x in wave.items():
                total[b] = total.get(b, 0) + x
        return total

    seeds = lambda k: {h: (1 - how.damping) * v[k] / v[0] for h, v in of.items() if v[k] and v[k] / v[0] >= how.seed_share}
    trust, distrust = ranks(edges, seeds(1)), ranks({(b, a): n for (a, b), n in edges.items()}, seeds(2))
    bad = {h for h, d in distrust.items() if d >= how.least_distrust and d > how.trust_weight * trust.get(h, 0)}
    return [(i, h, p, r and r[0] + r[1], r[2] if r else BLOCK if h in bad else ALLOW) for (i, _, _), ((h, p), _), r in zip(pages, at, ruled)], trust, distrust


def random_pages(seed, n=250):
    rng = random.Random(seed)
    hosts = [f"{a}.{b}" for a in ("a", "www.b", "B", "m.c", "d", "e", "spam", "x.spam") for b in ("example.com", "example.net", "test.org")] + ["com", "www.example.com", "example.com", "xexample.com"]
    link = lambda: rng.choice([f"http://{rng.choice(hosts)}/q", f"//{rng.choice(hosts)}", "/local", "#x", "mailto:a@b.c", "p.html"])
    rows = []
    for i in range(n):
        path = rng.choice(["", "/", "/en/", "/en/a", "/es/b", "/fr/c?q=http://com/en/", "/de", "?x=/en/", "#/en/"])
        html = "<p>" + "".join(f'<a class="k" href="{link()}">t</a><A HREF="{link()}">u</A>'.replace("HREF", "href") for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{rng.choice(hosts)}{path}", html))
    rows += [(900, None, None), (901, "no scheme", "<a href="), (902, "http:///en/x", ""), (902, "http:///en/x", ""), (903, "HTTP://WWW.EXAMPLE.COM/en/", None), (None, "x://a.net/es/", "<a href=''>"), (904, "://com", "")]
    return rows


def judged(spark, pages, rules=tuple(RULES), how=Spread()):
    got = url_filters.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(list(rules), RULE), how)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filters_against_brute_force(spark, seed):
    pages, how = random_pages(seed), Spread(least_distrust=0.01, trust_weight=0.5, rounds=6)
    rules = [*RULES, ("spam.test.org", "", BLOCK), ("d.test.org", "/", ALLOW)]
    want, trust, distrust = brute_judge(pages, rules, how)
    got = judged(spark, pages, rules, how).collect()
    key = lambda r: str(r)
    assert sorted(((r.page_id, *r["filter"][:4]) for r in got), key=key) == sorted(want, key=key)
    assert {(r["filter"].host, round(r["filter"].trust, 9), round(r["filter"].distrust, 9)) for r in got} == {(h, round(trust.get(h, 0), 9), round(distrust.get(h, 0), 9)) for _, h, *_ in want}
    assert any(v == BLOCK and rule is None for _, _, _, rule, v in want)


def test_many_rules_are_joined_alike(spark):
    pages = spark.createDataFrame([(*split_url(u), i) for i, u, _ in random_pages(3)], "host string, path string, page_id long")
    rules = [*RULES, ("b.example.com", "/e", BLOCK), ("com", "/en/", ALLOW), ("com", "/en/", BLOCK), ("example.net", "", ALLOW), ("", "/", BLOCK)]
    both = [sorted(map(str, url_filters.with_rules(pages, spark.createDataFrame(rules, RULE), n).select("page_id", "host", "path", "ruled").collect())) for n in (100, 2)]
    assert both[0] == both[1] and len(both[0]) == pages.count()
    ruled = {(r.host, r.path): r.ruled and tuple(r.ruled) for r in url_filters.with_rules(pages, spark.createDataFrame(rules, RULE)).collect()}
    for (h, p), found in ruled.items():
        want = brute_rule(h, p, [r for r in rules if r[0]])
        assert found == (want and (want[0] + want[1], want[2])), (h, p)


def test_distrust_runs_to_those_that_link_and_trust_saves(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(1, "http://bad.org/", ""), (2, "http://farm.org/a", link("bad.org")), (3, "http://good.org/", link("clean.org")), (4, "http://clean.org/", link("bad.org")), (5, "http://far.org/", "")]
    got = {r.page_id: r["filter"].verdict for r in judged(spark, pages, [("bad.org", "/", BLOCK), ("good.org", "/", ALLOW)]).collect()}
    assert got == {1: BLOCK, 2: BLOCK, 3: ALLOW, 4: ALLOW, 5: ALLOW}


def test_url_filters_odd_inputs(spark, put):
    empty = judged(spark, [])
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "filter"]
    odd = spark.createDataFrame([(1, "http://a.net/es/", "", "h", 3, 4)], PAGES + ", host string, blocked int, filter int").withColumn("a.b", F.lit(1)).withColumn("own", F.lit(2))
    row = url_filters.judge(odd, spark.createDataFrame(RULES, RULE)).first()
    assert row.host == "h" and row.blocked == 3 and row["filter"] == 4 and row["a.b"] == 1 and row.own == 2 and row.filter_.rule == "net/es/"
    long = "<a " * 300_000 + '<a href="http://z.org/">' + "<a href " * 100_000
    edges = url_filters.edges_of(spark.createDataFrame([("q.org", long), ("", long)], "host string, html string")).collect()
    assert [tuple(e) for e in edges] == [("q.org", "z.org", 1)]
    assert QUERIES["op11_url_filters"](spark, put([], PAGES, "pages")).count() == 0


def lloyd(rows, how):
    """(vec_id, cluster, distance), inertia by cluster and the centroids, one vector at a time."""
    kept = [(i, [int(np.floor(how.scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == how.dimensions and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    first = sorted((hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[: how.k]
    centers = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(how.rounds + 1):
        found = [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if turn == how.rounds:
            break
        for j in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, found)), key=str), centers


def vectors(seed, n, width, spread=0.4):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, width))
    rows = [(i, [float(x) for x in (heads[i % 6] + spread * rng.normal(size=width)).astype(np.float32)]) for i in range(n)]
    odd = [(None, rows[0][1]), (3000, None), (3001, []), (3002, [1.0] * (width - 1)), (3003, [None] + [1.0] * (width - 1)), (3004, [float("nan")] * width), (3005, [float("inf")] + [0.0] * (width - 1)), rows[3], rows[3], (3006, [0.0] * width)]
    return rows + odd


@pytest.mark.parametrize("width, k, n", [(3, 8, 160), (6, 25, 120), (2, 8, 5)])
def test_ball_kmeans_against_brute_force(spark, width, k, n):
    how, rows = Clustering(k=k, dimensions=width, rounds=6), vectors(width, n, width)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("cluster", F.lit("x"))
    got = ball_kmeans.cluster(df, how).collect()
    want, centers = lloyd(rows, how)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    for r in got:
        members = [d for _, j, d in want if j == r.cluster]
        assert (r.n_members, r.radius, r.cluster_inertia, r.inertia) == (len(members), max(members), sum(members), sum(d for *_, d in want))
        assert r.centroid == centers[r.cluster] and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_balls_spare_comparisons_and_break_ties():
    rng = np.random.default_rng(4)
    heads = rng.integers(-1000, 1000, (30, 16)) * 10
    x = heads[rng.integers(0, 30, 5000)] + rng.integers(-300, 300, (5000, 16))
    own = np.argmin(((x[:, None] - heads[None]) ** 2).sum(2), 1)
    cluster, distance, computed = ball_kmeans.moved(x, own, heads)
    assert (cluster == own).all() and computed < 2 * len(x)  # 30 for each vector without balls
    start = rng.integers(0, 30, 5000)
    again, same, _ = ball_kmeans.moved(x, start, heads)
    assert (again == own).all() and (same == distance).all()
    line = np.array([[0], [10], [20], [10]])
    points = np.array([[5], [15], [10], [5]])
    for begin in range(4):
        assert ball_kmeans.moved(points, np.full(4, begin), line)[0].tolist() == [0, 1, 1, 0]


def test_ball_kmeans_limits(spark, put):
    schema = "vec_id long, embedding array<float>"
    assert ball_kmeans.cluster(spark.createDataFrame([], schema)).count() == 0
    assert QUERIES["op12_ball_kmeans"](spark, put([], schema, "embeddings")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="too large"):
        ball_kmeans.to_integers(np.array([[3e8, 0.0]]), 1024.0)
    most = ball_kmeans.largest(64)
    large = np.array([[most, -most] * 32, [-most, most] * 32], np.int64)
    cluster, distance, _ = ball_kmeans.moved(large, np.array([1, 1]), large)
    assert cluster.tolist() == [0, 1] and distance.tolist() == [0, 0] and ball_kmeans.squared(large, large[0])[1] == 64 * (2 * most) ** 2


DOCS, LABELS = "doc_id long, source string, text string", "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    firsts, good, toxic, cells = {}, set(), set(), {}
    for i, _, t in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = []
    for i, source, text in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in firsts and firsts[t] < i}
        rows.append((source or "", fails, i in good, i in toxic))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                late = sum(r[1][f] for r in own) - len(gone)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                cells[part, order, k] = (len(left), len(gone), late, only, sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (p, order, k), c in cells.items():
            if p == part:
                cells[p, order, k] = (*c, total[order[k - 1]])
    return cells


def audited(spark, docs, labels):
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).withColumn("mask", F.lit(7)).withColumn("good", F.lit("g")), spark.createDataFrame(labels, LABELS))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for i in range(150):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4 if rng.random() < 0.5 else 30) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))]
        text = rng.choice([" ", "\n", "\t\x0b "]).join(words)
        text = text.upper() if rng.random() < 0.2 else text + " é#"[: rng.randint(0, 3)]
        docs.append((i, rng.choice(["s1", "s1", "s2", "", None]), text))
    docs += [(1000 + i, rng.choice(["s1", "s3"]), docs[i][2]) for i in range(40)] + [docs[3], docs[3], (None, "s1", docs[2][2]), (None, None, None), (2000, "s2", None), (2001, "s2", ""), (5, "s9", docs[7][2])]
    docs.append((3000, "s1", "wörd " * 400_000))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    one = audited(spark, [(1, None, "x")], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_parity_sums_invert_exactly(spark):
    counts = [(m * 7919) % 101 * 10**9 for m in range(32)]
    sums = [sum(n * (-1) ** bin(m & s).count("1") for m, n in enumerate(counts)) for s in range(32)]
    assert spark.createDataFrame([(sums,)], "s array<bigint>").select(filter_audit.mask_cells(F.col("s"))).first()[0] == counts
