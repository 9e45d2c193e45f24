"""The n-gram join against all pairs, on documents with copies, chains and shared passages."""

import random

import pytest

from lapline.llm import jaccard
from tests.llm.conftest import ODD


def grams(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return set()
    return {tuple(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))}


def brute(rows, words, num, den):
    sets = [(i, grams(t, words)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and len(x & y) * den >= len(x | y) * num:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, len(s), least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets))


def documents():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    for k in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 11, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6, 12])):  # each a few edits away from the one before: chains
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7, " ".join(words)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))  # in many documents, most of each
    rows += [(5000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 25))))
             for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, num, block", [(3, 90, 256), (5, 80, 16)])
def test_components_equal_all_pairs(table, monkeypatch, words, num, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = documents()
    got = jaccard.near_duplicates(table(rows).repartition(5), words, num, 100).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, words, num, 100)


def test_empty(table):
    assert jaccard.near_duplicates(table([])).count() == 0


def test_tiles_lose_no_pair():
    """Any two sets above the limit share a tile."""
    rng = random.Random(1)
    for measure in (jaccard.Measure(3, 90, 100), jaccard.Measure(5, 80, 100)):
        for _ in range(300):
            size = rng.randrange(5, 120)
            one = [rng.getrandbits(60) for _ in range(size)]
            cut = rng.randrange(0, size)
            other = one[cut // 8:] + [rng.getrandbits(60) for _ in range(rng.randrange(0, 1 + size // 9))]
            x, y = (jaccard.np.unique(jaccard.np.array(v, jaccard.np.uint64)) for v in (one, other))
            common = len(set(x.tolist()) & set(y.tolist()))
            if common * measure.den >= (len(x) + len(y) - common) * measure.num and set(x.tolist()) != set(y.tolist()):
                assert set(measure.tiles(x).tolist()) & set(measure.tiles(y).tolist())


@pytest.mark.parametrize("block, columns", [(16, 50)])
def test_links_equal_all_pairs(table, monkeypatch, block, columns):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rows = documents()
    sets = [(i, grams(t, 3)) for i, t in rows]

    def link(x, y):
        return bool(x and y) and len(x & y) * 100 >= len(x | y) * 80

    want = sorted(str((i, len(x), sum(link(x, y) for k, (j, y) in enumerate(sets) if j is not None and k != at),
                       len({frozenset(y) for j, y in sets if j is not None and y != x and link(x, y)})))
                  for at, (i, x) in enumerate(sets) if i is not None)
    data = table(rows).repartition(5)
    got = jaccard.link_counts(data, 3, 80, 100).where("doc_id is not null").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    least = {}
    for i, x in sets:
        if i is not None and x:
            least[frozenset(x)] = min(least.get(frozenset(x), i), i)
    names = list(least.items())
    pairs = sorted((min(i, j), max(i, j)) for k, (x, i) in enumerate(names) for y, j in names[:k] if link(x, y))
    assert len(pairs) > len(names)  # more than a spanning part
    assert sorted(tuple(r) for r in jaccard.link_pairs(data, 3, 80, 100).collect()) == pairs
