"""Ranked search by best positions against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from lapline.llm import positions
from tests.llm.conftest import ODD

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    held = [(i, tf) for i, tf in held if tf]
    number, total = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(term for _, tf in held for term in tf)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, tf in held:
            m = 50 + 50 * sum(tf.values()) * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) *
                        (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def tables():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(1, 400)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(600, docs[5][1].upper()), (600, "w1-W2_w3 É中 é")] + ODD
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(25)]
    items += [(40, docs[3][1]), (41, None), (42, ""), (43, "nowhere"), (None, "w1"), (44, "w1 w2"), (44, "w3 w3"),
              (45, "one TWO three"), (46, "É中,é\x00word")]
    return docs, items


def test_equal_to_scoring_all(table, monkeypatch):
    docs, items = tables()
    ddl = "item_id long, text string"
    for shard, asked in ((positions.SHARD, positions.ASKED), (300, 40)):  # one shard and block, and many
        monkeypatch.setattr(positions, "SHARD", shard)
        monkeypatch.setattr(positions, "ASKED", asked)
        monkeypatch.setattr(positions, "SLICE", 16)
        for k in (5, 50):
            got = positions.best_matches(table(docs), table(items, ddl), k).collect()
            assert sorted(map(tuple, got)) == plain(docs, items, k)


def test_empty_tables(table):
    docs, items = tables()
    ddl = "item_id long, text string"
    assert positions.best_matches(table([]), table(items, ddl)).collect() == []
    assert positions.best_matches(table(docs), table([], ddl)).collect() == []
    assert positions.best_matches(table([(1, None), (2, "--")]), table(items, ddl)).collect() == []
    assert positions.best_matches(table(docs), table([(1, "!?")], ddl)).collect() == []


def test_search_stops_before_the_ends_of_its_lists():
    """Long lists with few strong postings: documents beyond the best positions are never met."""
    rng = np.random.default_rng(1)
    number, lists = 20_000, 4
    terms = np.repeat(np.arange(lists, dtype=np.int32), number)
    docs = np.tile(np.arange(number, dtype=np.int32), lists)
    parts = (rng.pareto(1.5, number * lists) * 1000).astype(np.int64).clip(1, 900_000)
    weights = np.array([5, 7, 11, 13], np.int64)
    ids = rng.permutation(number * 10)[:number].astype(np.int64)
    shard = positions.Shard(weights, ids, terms, docs, parts)
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    scores, found = shard.search(np.arange(lists), 10, nothing)
    total = (parts * weights[terms]).reshape(lists, number).sum(axis=0)
    order = np.lexsort((ids, -total))[:10]
    assert found.tolist() == ids[order].tolist() and scores.tolist() == total[order].tolist()
    assert 0 < shard.met < number / 4
    assert not shard.seen.any() and not shard.known.any()  # ready for the next item


def test_equal_scores_beyond_the_kth_are_met():
    """All documents tie: the smallest ids win, wherever they lie in the lists."""
    number = 5000
    ids = np.random.default_rng(3).permutation(number).astype(np.int64)
    shard = positions.Shard(np.array([3], np.int64), ids, np.zeros(number, np.int32),
                            np.arange(number, dtype=np.int32), np.full(number, 10, np.int64))
    scores, found = shard.search(np.array([0]), 4, (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert found.tolist() == [0, 1, 2, 3] and scores.tolist() == [30] * 4
