"""Fingerprints and their links against a plain version."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lapline.llm import simhash
from tests.llm.conftest import ODD


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    width = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + width]).encode(), 42) for i in range(len(found) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """Component of each place by all pairs, and the number of linked places."""
    near = [[i for i, y in enumerate(values) if (x ^ y).bit_count() <= radius] for x in values]
    root = list(range(len(values)))
    changed = True
    while changed:
        low = [min(root[i] for i in n) for n in near]
        changed, root = low != root, low
    return root, [len(n) - 1 for n in near]


def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    out = list(base)
    for text in base:
        for _ in range(8):  # one word changed: a few bits
            parts = text.split()
            parts[rng.randrange(80)] = rng.choice(words)
            out.append("\t ".join(parts).upper())
    return out + base[:3] * 5


def rows():
    return ODD + [(100 + i, t) for i, t in enumerate(texts())]


def test_equal_to_all_pairs(table):
    given = rows()
    values = [plain_fingerprint(t) for _, t in given]
    assert len({v for v in values if v}) > 60
    for radius in (0, 1, 2, 3):
        root, links = plain_components(values, radius)
        least = {}
        for (doc_id, _), r in zip(given, root):
            if doc_id is not None:
                least[r] = min(least.get(r, doc_id), doc_id)
        want = [(i, f"{v:016x}", least.get(r)) + ((n,) if radius == 2 else ())
                for (i, _), v, r, n in zip(given, values, root, links)]
        got = [tuple(r) for r in simhash.near_duplicates(table(given), radius=radius).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), radius
        if radius == 2:
            assert len(set(root)) < len(set(values))  # there are links between different fingerprints


def test_planted_fingerprints_meet(spark):
    """Every pair of bits away is found, and nothing three bits away."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = set(base)
    for v in base:
        values |= {v ^ 1 << rng.randrange(64), v ^ 1 << rng.randrange(64) ^ 1 << 63, v ^ 0b111 << rng.randrange(60)}
    values |= {0, 2**64 - 1, 2**63}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    sets = spark.createDataFrame([(v, 1) for v in signed], "fingerprint long, n long")
    got = {r.fingerprint % 2**64: r.n for r in simhash.meetings(sets).groupBy("fingerprint").agg(
        (F.sum("others") / 2).cast("long").alias("n")).collect()}
    want = {v: sum((v ^ w).bit_count() <= 2 for w in values) - 1 for v in values}
    assert got == {v: n for v, n in want.items() if n}


def test_shingles_hash_as_sparks_own(spark):
    assert [r.h for r in spark.createDataFrame([("one two three",)], "t string").select(
        F.xxhash64("t").alias("h")).collect()] == [np.uint64(plain_fingerprint("One two  three")).view(np.int64)]


def test_rows_without_doc_id_and_empty_tables(table):
    assert simhash.near_duplicates(table([])).collect() == []
    got = simhash.near_duplicates(table([(None, "a b c d"), (None, "a b c d"), (None, "q")])).collect()
    assert [(r.doc_id, r.component_id, r.n_links) for r in sorted(got, key=lambda r: -r.n_links)] == [
        (None, None, 1), (None, None, 1), (None, None, 0)]
    # a link that runs through a row without doc_id counts
    got = simhash.near_duplicates(table([(None, "a b c"), (7, "a b c"), (9, "A B C")])).collect()
    assert {r.component_id for r in got} == {7}
