"""Search, neighbours and URL rules against plain versions."""

import itertools
import math
import random
from collections import Counter
from math import fsum

import numpy as np
import pytest

from lapline.llm import neighbours, search, urls
from tests.llm.conftest import ODD


def best_by_brute_force(rows, every, terms, k):
    texts = {i: search.terms_of(t) for i, t in rows if i is not None}
    total = sum(i is not None for i, _ in rows)
    mean = sum(len(search.terms_of(t)) for i, t in rows if i is not None) / total
    bags = {i: Counter(map(search.hashed, t)) for i, t in texts.items()}
    df = Counter(w for i, t in rows if i is not None for w in {*map(search.hashed, search.terms_of(t))})
    idf = {w: math.log(1 + (total - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q in bags:
        if q % every:
            continue
        chosen = sorted(bags[q], key=lambda w: (-idf[w] * bags[q][w] / (bags[q][w] + 1.2), w))[:terms]
        scored = []
        for d, bag in bags.items():
            parts = [idf[w] * (bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean)))
                     for w in chosen if w in bag]
            if parts and d != q:
                scored.append((-round(fsum(parts), 9), d))
        out += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, asked", [(500_000, 500_000), (300, 200)])
def test_search_equals_brute_force(table, monkeypatch, shard, asked):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "ASKED", asked)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(2)
    words = [f"w{int(1.08 ** rng.randrange(90))}" for _ in range(300)]
    rows = ODD + [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[-1][1]) for i in range(40)]  # copies: equal scores
    got = search.more_like(table(rows).repartition(4), every=20, terms=5, k=6).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got) == best_by_brute_force(rows, 20, 5, 6)


@pytest.mark.parametrize("shard, asked, run", [(6_000_000, 4_000_000, 16), (3000, 2000, 2)])
def test_search_takes_all_terms_of_a_row(table, monkeypatch, shard, asked, run):
    for name, value in (("SHARD", shard), ("ASKED", asked), ("BLOCK", 8), ("RUN", run)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    words = [f"w{int(1.08 ** rng.randrange(90))}" for _ in range(300)]
    # each row has more words of its own than an extract of a few terms would hold
    rows = ODD + [(10 + i, " ".join([rng.choice(words) for _ in range(rng.randrange(1, 90))]
                                    + [f"own{i}x{j}" for j in range(12)])) for i in range(300)]
    rows += [(1000 + i, rows[-1][1]) for i in range(40)]
    got = search.more_like(table(rows).repartition(4), every=20).collect()
    want = best_by_brute_force(rows, 20, None, 10)
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(sum(w[0] == 20 * q for w in want) == 10 for q in range(1, 15))


def test_cursors_skip_blocks_that_cannot_hold_one_of_the_best(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "RUN", 2)
    rng = np.random.default_rng(3)
    # 1,000 documents in families that share their words, and a few words that all have
    lists = {t: np.sort(rng.choice(1000, 700, False)) for t in range(4)}
    lists |= {4 + f: np.arange(f * 20, f * 20 + 20) for f in range(50)}
    bounds = np.concatenate([[0], np.cumsum([len(lists[t]) for t in range(54)])])
    docs = np.concatenate([lists[t] for t in range(54)]).astype(np.int32)
    weights = rng.random(len(docs)) + np.repeat(np.arange(54) >= 4, np.diff(bounds)) * 5
    ids = rng.permutation(5000)[:1000]
    shard = search.Shard(ids, bounds, docs, weights)
    for family in range(50):
        terms = np.array([0, 1, 2, 3, 4 + family])
        own = int(ids[family * 20])
        want = sorted(((-fsum(weights[bounds[t]:bounds[t + 1]][docs[bounds[t]:bounds[t + 1]] == d][0] for t in terms
                              if d in lists[t]), int(ids[d])) for d in range(1000) if ids[d] != own))[:10]
        assert shard.search(own, terms, 10) == [(-s, d) for s, d in want]
    assert 0 < shard.read < 0.2 * shard.held


def test_queries_side_by_side_over_long_lists(monkeypatch):
    """Lists of many documents are added by one product for all queries; scores stay exact and blocks are skipped."""
    for name, value in (("BLOCK", 8), ("RUN", 2), ("STRIDE", 2)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    n = 500
    lists = [np.sort(rng.choice(n, size, False)) for size in [400, 450, 300, 499, 120] + [25] * 40]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    docs = np.concatenate(lists).astype(np.int32)
    weights = rng.random(len(docs)) * np.repeat(rng.random(len(lists)) * 9, np.diff(bounds))
    weights[bounds[1]:bounds[2]] = 0.1  # many equal weights, which single precision can't hold
    ids = rng.permutation(3000)[:n]
    shard = search.Shard(ids, bounds, docs, weights)
    assert (shard.row >= 0).sum() == 5 and len(shard.docs) == 40 * 25
    terms = [np.sort(rng.choice(len(lists), rng.integers(0, 12), False)) for _ in range(30)] + [np.array([1]), np.array([1, 3])]
    queries = ids[:31].tolist() + [-7]
    got = shard.search_all(queries, terms, 10)
    for query, own, best in zip(queries, terms, got):
        parts = {}
        for t in own.tolist():
            for d, w in zip(lists[t].tolist(), weights[bounds[t]:bounds[t + 1]].tolist()):
                parts.setdefault(int(ids[d]), []).append(w)
        parts.pop(query, None)
        assert best == [(-s, d) for s, d in sorted((-fsum(x), d) for d, x in parts.items())[:10]]
        assert best == shard.search(query, own, 10)
    assert 0 < shard.read < 0.9 * shard.held


def test_search_of_nothing(table):
    assert search.more_like(table([])).count() == 0
    assert search.more_like(table([(20, None), (None, "a")])).count() == 0


def vectors(n=1500, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + 0.7 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(200)]  # one vector very often
    odd = [(5000, None), (5050, []), (5100, [0.0] * dim), (5150, [float("nan")] * dim), (5200, [1.0, None] * (dim // 2)),
           (None, rows[0][1]), (5250, [1.0, 2.0]), (5300, [float("inf")] + [1.0] * (dim - 1)), (0, rows[0][1])]
    return rows, odd


def exact(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for q, own in zip(ids, x):
        if q % every:
            continue
        score = (x * own).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((own * own).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out += [(int(q), r, int(ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("rows_per_block", [20_000, 150])
def test_neighbours(table, monkeypatch, rows_per_block):
    monkeypatch.setattr(neighbours, "ROWS", rows_per_block)
    rows, odd = vectors()
    data = table(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    want = exact(rows, 50, 5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(data, share=1.0, halves=8).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-12
    part = neighbours.nearest(data, halves=8).collect()
    assert len({(r.query_id, r.vec_id) for r in part} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)


def test_few_or_no_neighbours(table):
    ddl = "vec_id long, embedding array<float>"
    got = neighbours.nearest(table([(50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], ddl)).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert neighbours.nearest(table([], ddl)).count() == 0
    assert neighbours.nearest(table([(50, [1.0])], ddl)).count() == 0


URLS = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.COM/en/x?y=1#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"), ("http://notnet/es/", "notnet", "/es/", None, "allow"),
    ("http://com", "com", "", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("", "", "", None, "allow"), ("http://É.com/", "É.com", "/", "com/", "allow"), ("a://b://c.com/d", "b:", "//c.com/d", None, "allow"),
    ("http://h.org?q=/x", "h.org", "", None, "allow"), ("http://x.com/\nen", "x.com", "/\nen", "com/", "allow"),
]


def test_given_rules(table):
    pages = table([(i, u) for i, (u, *_) in enumerate(URLS)], "page_id long, url string")
    labels = table([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, labels).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(URLS)}


def test_mined_rules_equal_brute_force(table):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        host, part = rng.choice(["spam", "news", "blog"]), rng.choice(["win", "story", "faq"])
        rows.append((i, f"http://{host}.site.org/{part}/{i}"))
        if i % 3:
            bad = rng.random() < (0.95 if (host, part) == ("spam", "win") else 0.05)
            labels.append((i, 0 if bad else 1, None if i % 2 else int(bad)))
    labels += [(None, 0, 1), (1, None, None)]
    got = urls.filter_urls(table(rows * 2, "page_id long, url string"),
                           table(labels, "doc_id long, quality int, toxic int"))
    got = got.select("page_id", "verdict", "confidence").collect()
    assert len(got) == 2 * len(rows)

    def items(url):
        host, part, _ = url[7:].split("/")
        return {"scheme:http", *(f"host:{x}" for x in host.split(".")), f"path:{part}", "path:0"}

    bad = {}
    for i, quality, toxic in labels:
        if i is not None:
            bad[i] = bad.get(i, False) or quality == 0 or toxic == 1
    known = [(items(u), bad[i]) for i, u in rows if i in bad]
    rate = sum(b for _, b in known) / len(known)
    names = sorted({x for xs, _ in known for x in xs})
    sure = {}
    for size in range(1, 6):
        for some in itertools.combinations(names, size):
            hit = [b for xs, b in known if xs.issuperset(some)]
            if sum(hit) >= max(8, 0.002 * len(known)) and sum(hit) / len(hit) >= max(0.6, 1.5 * rate):
                sure[some] = sum(hit) / len(hit)
    want = {i: max([c for some, c in sure.items() if items(u).issuperset(some)], default=None) for i, u in rows}
    assert any(want.values())
    for r in got:
        assert r.verdict == ("allow" if want[r.page_id] is None else "block")
        assert r.confidence is None or abs(r.confidence - want[r.page_id]) < 1e-9


@pytest.mark.parametrize("small", [4096, 20])
def test_each_length_of_vectors_and_all_vectors_of_an_id(table, monkeypatch, small):
    monkeypatch.setattr(neighbours, "SMALL", small)
    rng = np.random.default_rng(4)
    rows = [(i % 200, rng.normal(size=dim).tolist()) for dim in (4, 6, 8) for i in range(260 if dim == 6 else 90)]
    got = neighbours.nearest(table(rows, "vec_id long, embedding array<double>"), share=1.0, halves=4).collect()
    best = {}
    for q, own in rows:
        for i, v in rows:
            if q % 50 == 0 and i != q and len(v) == len(own):
                score = float(np.dot(own, v) / (np.linalg.norm(own) * np.linalg.norm(v)))
                best[q, i] = max(score, best.get((q, i), -2.0))
    want = [(q, r, i) for q in (0, 50, 100, 150) for r, (_, i) in enumerate(
        sorted((-s, i) for (p, i), s in best.items() if p == q)[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    assert all(abs(r.score - best[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_copies_of_a_long_url(table):
    """All combinations of 40 segments that 20 pages share would be 2 to the power of 40 rules."""
    long = "http://bad.org/" + "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, long) for i in range(20)] + [(i, f"http://good.org/{i}") for i in range(20, 100)]
    rows += [(100, "http://other.org/saa/x"), (101, "http://good.org/x")]
    labels = [(i, 0 if i < 19 else 1, 0) for i in range(100)]
    got = {r.page_id: (r.verdict, r.confidence) for r in urls.filter_urls(
        table(rows, "page_id long, url string"), table(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block", 0.95) for i in (*range(20), 100))
    assert all(got[i] == ("allow", None) for i in (*range(20, 100), 101))
