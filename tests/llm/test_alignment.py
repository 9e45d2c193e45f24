"""Two tokenizers aligned, against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lapline.llm import alignment
from lapline.llm.bpe import LETTERS
from tests.llm.conftest import ODD

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = "aAbB'sStT  \n\t\x1f é́ßΣ中日1²<|endoftext|>_-…▁😀\x00<0x0A>"


def rows():
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(150)]
    made += ["the theatre of the anderson family", "the theatre of the anderson family", "a<|endoftext|>b", "x▁y"]
    return ODD + [(100 + i, t) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def tokens():
    """(ranges with ids of A, of B) of a text, by the libraries."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {letter: i for i, letter in enumerate(LETTERS)}

    def ranges(parts):
        out, start = [], 0
        for i, data in parts:
            out.append((start, start + len(data), i))
            start += len(data)
        return out

    def of(text):
        if not text:
            return [], []
        parts_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text).ids]
        parts_b = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            parts_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(data for _, data in parts) != whole for parts in (parts_a, parts_b)):
            return [], []
        return ranges(parts_a), ranges(parts_b)
    return of


def plain(rows, tokens):
    links, groups, count = [], [], Counter()
    for _, text in rows:
        a, b = tokens(text)
        links.append([(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]])
        count.update(set(links[-1]))
        cuts, out = sorted({x[1] for x in a} & {y[1] for y in b}), []
        for low, high in zip([0, *cuts], cuts):
            out.append("|".join(",".join(str(t[2]) for t in side if low <= t[0] < high) for side in (a, b)))
        groups.append(out)
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    for (doc_id, text), pairs, out in zip(rows, links, groups):
        a, b = tokens(text)
        yield (doc_id, len(a), len(b), len(out), len(pairs), sum(count[p] == highest[p[0]] for p in pairs),
               sum(count[p] for p in pairs), hashlib.sha256(";".join(out).encode()).hexdigest() if out else "")


def test_equal_to_plain_loops(table, tokens, monkeypatch):
    # short texts only: the plain loop compares all pairs of tokens
    given = [r for r in rows() if r[1] is None or len(r[1]) < 1000]
    want = sorted(plain(given, tokens), key=repr)
    for block in (alignment.BLOCK, 200):  # one block a task, and many
        monkeypatch.setattr(alignment, "BLOCK", block)
        monkeypatch.setattr(alignment, "TEXTS", 500)
        got = [tuple(r) for r in alignment.align(table(given), A, B).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
        assert sorted(got, key=repr) == want


def test_very_long_texts(table, tokens):
    got = {r.doc_id: r for r in alignment.align(table(rows()), A, B).where("doc_id in (6, 7)").collect()}
    for doc_id, text in [r for r in ODD if r[0] in (6, 7)]:
        a, b = tokens(text)
        cuts = {x[1] for x in a} & {y[1] for y in b}
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(cuts), len(a) + len(b) - len(cuts))


def test_empty_tables(table):
    assert alignment.align(table([]), A, B).collect() == []
    got = alignment.align(table([(1, None), (2, "")]), A, B).collect()
    assert [(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in got] == [(0, 0, 0, "")] * 2


def test_pointers_reach_the_terminal_of_a_long_chain():
    """Tokens of two bytes against tokens of two bytes shifted by one: one component, however long."""
    n = 100_000
    ends_a = np.append(np.arange(2, 2 * n, 2), 2 * n)
    ends_b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    label = alignment.terminals(ends_a, ends_b)
    assert set(label.tolist()) == {len(ends_a) + len(ends_b) - 1}
    ends = np.arange(1, 6)  # all ends are shared: a group for each
    assert alignment.terminals(ends, ends).tolist() == [5, 6, 7, 8, 9] * 2
