"""Alignment of two tokenizers by pointer jumping.

The tokens of both tokenizers over one text are ranges of its bytes. Every token points to its farthest-right
overlapping token; doubling the pointers of a whole batch of texts at once takes each to the terminal token of its
component, in as many rounds as the logarithm of the longest chain. Terminals label the groups: the texts' parts
between places where tokens of both end. How many documents hold a pair of linked ids is counted by block of texts,
and the counts of a block's pairs come back to the block, so no pair of a document is shuffled by its ids.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lapline.llm.bpe import LETTERS
from lapline.llm.positions import spread
from lapline.llm.shared import Scratch

#: Characters of texts that are aligned at once, tokens of a block (a row counts as one more in both).
TEXTS, BLOCK = 1 << 20, 1_500_000
SHIFT = 32
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Pair:
    """Tokenizer A (byte-level, of the tokenizers library) and B (pieces, of sentencepiece)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: bytes([b]) for b, letter in enumerate(LETTERS)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.bytes_a[i] = b"".join([byte_of[letter] for letter in name])
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in held]) for held in (self.bytes_a, self.bytes_b))
        # what a token is in the digest, by what comes after it: another of its side, the other side, a new group
        numbers = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.width = len(numbers)
        self.written = [n + sign for sign in ",|;" for n in numbers]

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for texts that begin with the space which B adds, or with a line feed inside a text; both
        empty where the bytes aren't the text's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        # no piece has a line feed, so the space added before one is a token of its own
        ids_b = [ids if text[0] == " " else ids[1:] for text, ids in zip(texts, ids_b)]
        data = [text.encode() for text in texts]
        sizes, joined = np.cumsum(list(map(len, data))), b"".join(data)
        for ids, names, lengths in ((ids_a, self.bytes_a, self.sizes_a), (ids_b, self.bytes_b, self.sizes_b)):
            flat = list(itertools.chain.from_iterable(ids))
            ends = np.cumsum([0, *map(len, ids)])[1:]
            reached = np.append(0, np.cumsum(lengths[flat]))[ends]
            if b"".join(map(names.__getitem__, flat)) != joined or not np.array_equal(reached, sizes):
                break
        else:
            return ids_a, ids_b
        for place, whole in enumerate(data):
            if any(b"".join(map(names.__getitem__, ids[place])) != whole
                   for ids, names in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
                ids_a[place], ids_b[place] = [], []
        return ids_a, ids_b


@functools.lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    return Pair(path_a, path_b)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token (those of A, then those of B) the terminal of its component of overlapping ranges.

    Ranges lie end to end and both sides end at the same place. A token's farthest-right overlapping token is that of
    the other side which holds its last byte; a token of B that ends with one of A is its own, the terminal.
    """
    number = len(ends_a)
    right = np.searchsorted(ends_a, ends_b)
    own = np.arange(number, number + len(ends_b))
    to = np.concatenate([number + np.searchsorted(ends_b, ends_a), np.where(ends_a[right] == ends_b, own, right)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def linked(ids_a, ids_b, ends_a, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Places (ends) and keys of all overlapping pairs: between two ends that follow each other lies one pair."""
    places = np.union1d(ends_a, ends_b)
    return places, (ids_a[np.searchsorted(ends_a, places)] << SHIFT) + ids_b[np.searchsorted(ends_b, places)]


def aligned(pair: Pair, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of texts as ``Pair.encode`` takes them: (n_a, n_b, n_groups, n_links) of each, the groups of each as the digest
    has them, and the keys of all linked pairs, one text after the other."""
    ids_a, ids_b = pair.encode(texts)
    many_a, many_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    counts = np.zeros((len(texts), 4), np.int64)
    if not many_a.any():
        return counts, [""] * len(texts), np.empty(0, np.int64)
    ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, many.sum())
                    for ids, many in ((ids_a, many_a), (ids_b, many_b)))
    # the texts lie one after the other, and both sides end with each: no component has tokens of two
    ends_a, ends_b = np.cumsum(pair.sizes_a[ids_a]), np.cumsum(pair.sizes_b[ids_b])
    label = terminals(ends_a, ends_b)
    places, keys = linked(ids_a, ids_b, ends_a, ends_b)
    stops = np.append(0, ends_a)[np.cumsum(many_a)]
    # the digest: groups in order, in each the tokens of A before those of B
    number = len(ids_a)
    side = np.zeros(len(label), np.int8)
    side[number:] = 1
    order = np.lexsort((side, label))
    label, side = label[order], side[order]
    ids = np.concatenate([ids_a, ids_b])[order]
    new_group = np.append(label[1:] != label[:-1], True)
    new_side = np.append(side[1:] != side[:-1], True)
    codes = ids + pair.width * np.where(new_group, 2, np.where(new_side, 1, 0))
    strings = list(map(pair.written.__getitem__, codes.tolist()))
    cuts = np.append(0, np.cumsum(many_a + many_b))
    counts[:, 0], counts[:, 1] = many_a, many_b
    counts[:, 2] = np.diff(np.append(0, np.cumsum(new_group))[cuts])
    counts[:, 3] = np.diff(np.searchsorted(places, stops, "right"), prepend=0)
    return counts, ["".join(strings[x:y])[:-1] for x, y in itertools.pairwise(cuts.tolist())], keys


class Stretches:
    """What comes of each stretch of a text, worked out once while it is held.

    A text is cut before a space or line feed between two other characters. Tokens of both sides end there: A's pattern
    takes white space only to the left of a word, and no piece of B has its space or a line feed but at the start. So a
    text's groups, links and counts are those of its stretches, one after the other.
    """

    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
    #: Stretches and characters of them that are held.
    ROWS, SIZE = 250_000, 8_000_000

    def __init__(self, pair: Pair):
        if any(name.lstrip("▁").find("▁") >= 0 or "\n" in name for name in map(
                pair.b.id_to_piece, range(pair.b.get_piece_size()))):
            raise ValueError("B has pieces that go on after a space or a line feed")
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # by what str.split gives; -1: the text is to be cut by CUT
        self.places: dict[str, int] = {}  # by what CUT gives
        self.groups: list[str] = []
        self.counts, self.keys, self.size = np.empty((0, 4), np.int64), np.empty(0, np.int64), 0

    def add(self, names: list[str], stretches: list[str], places: dict[str, int]) -> None:
        if names:
            counts, groups, keys = aligned(self.pair, stretches)
            places.update(zip(names, itertools.count(len(self.groups))))
            self.groups += groups
            self.counts = np.concatenate([self.counts, counts])
            self.keys = np.concatenate([self.keys, keys])
            self.size += sum(map(len, stretches))

    def places_of(self, texts: list[str]) -> list[list[int]]:
        """The stretches of each text. Most texts have single spaces and line feeds only and are cut by str.split."""
        parts = [text.replace("\n", " \n").split(" ") if text else [] for text in texts]
        words, new = self.words, []
        for word in set().union(*parts).difference(words):
            inner = word.removeprefix("\n")
            if not inner or inner[0].isspace() or inner[-1].isspace():
                words[word] = -1
            else:
                new.append(word)
        self.add(new, [word if word[0] == "\n" else " " + word for word in new], words)
        out = [list(map(words.__getitem__, found)) for found in parts]
        for place, (text, found) in enumerate(zip(texts, out)):
            if text and (text[0].isspace() or -1 in found):
                stretches = self.CUT.split(text)
                stretches[0] = " " + stretches[0]
                new = list(set(stretches).difference(self.places))
                self.add(new, new, self.places)
                out[place] = list(map(self.places.__getitem__, stretches))
        return out

    def align(self, texts: list[str]) -> tuple[list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
        """(n_a, n_b, n_groups, n_links, digest) of each text; its distinct pairs and how often each comes."""
        if len(self.groups) > self.ROWS or self.size > self.SIZE:
            self.clear()
        places = self.places_of(texts)
        number = [len(p) for p in places]
        flat = np.fromiter(itertools.chain.from_iterable(places), np.int64, sum(number))
        owner = np.repeat(np.arange(len(texts)), number)
        whole = np.array(number) > 0
        whole[owner[self.counts[flat, 0] == 0]] = False
        keep = whole[owner]
        flat, owner = flat[keep], owner[keep]
        counts = self.counts[flat]
        columns = [np.bincount(owner, x, len(texts)).astype(np.int64).tolist() for x in counts.T]
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, p)).encode()).hexdigest() if w else ""
                   for p, w in zip(places, whole.tolist())]
        bounds = np.append(0, np.cumsum(self.counts[:, 3]))
        found, numbers = np.unique(self.keys[spread(bounds[flat], bounds[flat + 1])], return_inverse=True)
        found = np.append(found, 0)  # so that there is one even where no text has tokens
        both, times = np.unique(np.repeat(owner, counts[:, 3]) * len(found) + numbers, return_counts=True)
        cuts = np.searchsorted(both, np.arange(len(texts) + 1) * len(found)).tolist()
        keys = found[both % len(found)]
        return list(zip(*columns, digests)), [(keys[x:y], times[x:y]) for x, y in itertools.pairwise(cuts)]


def align_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Kind 0, for each row of ``docs``: its block, the digest columns, and its linked pairs as places in the block's
    table of pairs with how often each comes (4 bytes each). Kind 1, for each block: the keys of its pairs in order
    (8 bytes each) and how many of its rows hold them (4 bytes each)."""

    def run(batches):
        stretches, rows, keys, tokens = Stretches(pair_of(path_a, path_b)), [], [], 0
        block = TaskContext.get().partitionId() << 32
        for ids, texts in portions(batches):
            known, found = stretches.align(texts)
            rows += [(i, *row) for i, row in zip(ids, known)]
            keys += found
            tokens += sum(row[0] + row[1] + 1 for row in known)
            if tokens >= BLOCK:
                yield from blocked(block, rows, keys)
                rows, keys, tokens, block = [], [], 0, block + 1
        if rows:
            yield from blocked(block, rows, keys)

    def portions(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text) + 1
                if size >= TEXTS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def blocked(block, rows, keys):
        table, inverse, docs = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True, return_counts=True)
        inverse, start = inverse.astype(np.int32), 0
        pairs, times = [], []
        for found, each in keys:
            pairs.append(inverse[start:start + len(found)].tobytes())
            times.append(each.astype(np.int32).tobytes())
            start += len(found)
        for low in range(0, len(rows), 1000):
            part = slice(low, low + 1000)
            yield batch_of(0, block, list(zip(*rows[part])), pairs[part], times[part])
        yield batch_of(1, block, [[None]] * 6, [table.tobytes()], [docs.astype(np.int32).tobytes()])

    def batch_of(kind, block, columns, *binaries):
        n = len(columns[0])
        types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.int8()), pa.array([block] * n, pa.int64()),
             *(pa.array(c, t) for c, t in zip((*columns, *binaries), types))], names)

    names = ["kind", "block", *(c.split(" ")[0] for c in COUNTED.split(", ")), "pairs", "times"]
    return docs.mapInArrow(run, f"kind byte, block long, {COUNTED}, pairs binary, times binary")


def block_pairs(found: DataFrame) -> DataFrame:
    """block, pair, docs: how many rows of a block hold a pair."""

    def run(batches):
        for batch in batches:
            for block, pairs, docs in zip(*(column.to_pylist() for column in batch.columns)):
                keys, docs = np.frombuffer(pairs, np.int64), np.frombuffer(docs, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block)), pa.array(keys), pa.array(docs)], ["block", "pair", "docs"])

    return found.where("kind = 1").select("block", "pairs", "times").mapInArrow(run, "block long, pair long, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (no pair of its A id has a higher count)."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    same = Window.partitionBy(F.shiftright("pair", SHIFT))  # at most one row for each id of B
    return counts.withColumn("best", F.col("count") == F.max("count").over(same))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both tokenizers' tokens of each row of ``docs`` (doc_id, text), grouped and linked.

    Gives doc_id, n_a and n_b (tokens), n_groups (parts between places where tokens of both end), n_links (pairs of
    tokens that overlap), n_best (links whose id pair is held by the most documents of all pairs of its A id, ties
    included), count_sum (over all links, the documents that hold the link's id pair) and groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space; special strings are plain text. Texts that
    are null, empty, or whose tokens' bytes aren't those of the text have no tokens: zeros and an empty digest.
    Rows are documents: repeated rows count and come out repeated, a null doc_id stays null, an empty table gives
    none, other columns are left out. Whole texts are encoded, however long.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    found = scratch.write(align_texts(docs, path_a, path_b), "aligned")
    pairs = scratch.write(block_pairs(found), "pairs")
    counts = scratch.write(pair_counts(pairs), "counts")
    # the join's larger side has one row for each block and pair: a pair that all blocks hold is split if it gets large
    known = scratch.write(pairs.join(counts, "pair").select("block", "pair", "count", "best"), "known")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["pair"].to_numpy())  # as the block's table has them
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for pairs, times in zip(rows["pairs"], rows["times"]):
            places, times = (np.frombuffer(x.as_buffer(), np.int32) for x in (pairs, times))
            n_best.append(int(times[best[places]].sum()))
            count_sum.append(int((count[places] * times).sum()))
        out = {name: rows[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        return pa.table(out | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    return found.where("kind = 0").drop("kind").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        run, f"{COUNTED}, n_best long, count_sum long")


def op11_pointer_jumping(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
