"""Encoding, counting and packing against the vocabularies' own library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapline.llm import bpe, packing, token_counts
from tests.llm.conftest import ODD

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = "aAbB'sStT  \n\t\x1c\x1f\x85\u2003é\u0301ÉßΣσİ中日1٣²½<|endoftext|>_-…’\u200b 😀ﬁ\x00\x7f#%"


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(600)]
    return made + ["<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "aaaa" * 300, "don't we'll THE'RE", "?!" * 200,
                   "the theatre anderson " * 300, "  two  spaces\n\n\nlines ", "lllllllll " * 20]


def rows():
    return ODD + [(100 + i, t) for i, t in enumerate(texts())]


def test_encoding_and_decoding(table):
    library = Tokenizer.from_file(WORDS)
    got = bpe.encode_texts(table(rows()), WORDS, keep_ids=True).collect()
    assert len(got) == len(rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        for r in by_id[doc_id]:
            assert r.ids == ids and r.n_tokens == len(ids), text[:50]
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_decoding_ids(spark):
    rows = spark.createDataFrame([(1, [320, 49407, None, 10**8]), (2, None), (3, [])], "doc_id long, ids array<int>")
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.text for r in bpe.decode_ids(rows, WORDS).collect()}
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_every_gadget_leaves_one_path():
    """The automaton's path is what merging by rank gives, also where merges overlap themselves."""
    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "aa", "ab", "aaa", "aab", "bc", "aabc"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("aa", "b"), ("b", "c"), ("aa", "bc")]
    automaton = bpe.MergeAutomaton(vocabulary, merges)
    ranks = {m: r for r, m in enumerate(merges)}
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("aaabc") for _ in range(rng.randrange(1, 12)))
        assert len(automaton.walk(word)) == token_counts.merged(list(word), ranks) == token_counts.merged_long(
            list(word), ranks), word


def test_counts(table):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(table(rows()), BYTES, limit=20).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids),
                   n > 20) for i, t in rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_whole_tokens_are_proven():
    counter = token_counts.token_counter(BYTES)
    library = Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    for name in rng.sample(sorted(counter.whole), 500):
        text = bytes(bpe.LETTERS.index(c) for c in name).decode("utf-8", "ignore")
        if len(token_counts.regex.findall(token_counts.SPLIT, text)) == 1 and "\ufffd" not in text and text.isprintable():
            assert len(library.encode(text, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("group_pieces", [50_000, 40])
def test_packing(table, group_pieces):
    library = Tokenizer.from_file(WORDS)
    got = packing.pack(table(rows()), WORDS, capacity=64, end_id=2, group_pieces=group_pieces).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows()}
    assert sum(r.length for r in got) == sum(len([*ids[i]]) for i, _ in rows())
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    if group_pieces == 50_000:
        assert len(sequences) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_first_fit_decreasing_takes_the_first_bin_that_fits():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 50) for _ in range(300)), reverse=True)
    room, want = [], []
    for n in lengths:
        k = next((k for k, free in enumerate(room) if free >= n), len(room))
        if k == len(room):
            room.append(60)
        want.append((k, 60 - room[k]))
        room[k] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths, 60))) == want


def test_empty_tables(table):
    for run in (bpe.encode_texts, token_counts.count_tokens, packing.pack):
        assert run(table([]), BYTES if run is token_counts.count_tokens else WORDS).count() == 0


def test_every_character_has_the_ids_of_the_library():
    """All code points below U+20000, alone and between letters."""
    library, encoder = Tokenizer.from_file(WORDS), bpe.word_encoder(WORDS)
    for form in ("{}", "a{}b"):
        texts = [form.format(chr(c)) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert [i for s in encoder.stretches(text) for i in encoder.stretch(s)] == want.ids, ascii(text)
