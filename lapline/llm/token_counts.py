"""Token counts of a byte-level vocabulary by the whole-token shortcut.

Before any text is read, each vocabulary string is put through the merges once. Those that come out as one token are
proven whole: a pre-token that equals one counts 1 without any merge. Only the rest is merged.
"""

from __future__ import annotations

import heapq
import re
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lapline.llm.bpe import LETTERS, load
from lapline.llm.shared import Memo, kept, narrowed, sliced

#: The pattern that splits a text before the merges (a fixed value of the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 48


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens the merges leave of ``symbols``: the lowest rank first, of equals the leftmost."""
    if len(symbols) > LONG:
        return merged_long(symbols, ranks)
    get = ranks.get
    while len(symbols) > 1:
        found = [get(pair) for pair in zip(symbols, symbols[1:])]
        best = min([r for r in found if r is not None], default=None)
        if best is None:
            break
        at = found.index(best)
        left, right = symbols[at], symbols[at + 1]
        out, i, end = symbols[:at], at, len(symbols)
        while i < end:
            if i + 1 < end and symbols[i] == left and symbols[i + 1] == right:
                out.append(left + right)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return len(symbols)


def merged_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The same by a heap over a linked list: n log n steps for a pre-token of any length."""
    end = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, islice(symbols, 1, None))) if pair in ranks]
    heapq.heapify(heap)
    count = end
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= end or (symbols[i], symbols[j]) != pair:
            continue
        symbols[i], symbols[j] = pair[0] + pair[1], None
        after[i] = after[j]
        if after[i] < end:
            before[after[i]] = i
        count -= 1
        for k in (before[i], i):
            if k >= 0 and after[k] < end:
                pair = symbols[k], symbols[after[k]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], k, pair))
    return count


class TokenCounter:
    """Counts tokens of whole texts."""

    #: A space between two letters or signs: what lies on either side is split and merged on its own.
    CLEAN = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        spec = load(path)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cutter = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.whole = {name for name in model["vocab"] if merged(list(name), self.ranks) == 1}
        self.words = Memo(self._word, 100_000)
        self.first = Memo(self._chunk, 50_000)
        self.later = Memo(lambda chunk: self._chunk(" " + chunk), 400_000)

    def _word(self, piece: str) -> int:
        """Tokens of a pre-token in byte letters that isn't whole."""
        return merged(list(piece), self.ranks)

    def _pieces(self, text: str) -> int:
        count, whole, words = 0, self.whole, self.words
        for piece in self.split(text):
            letters = "".join([LETTERS[b] for b in piece.encode("utf-8", "replace")])
            if letters in whole:
                count += 1
            elif len(letters) <= LONG:
                count += words[letters]
            else:
                count += merged(list(letters), self.ranks)
        return count

    def _chunk(self, chunk: str) -> int | None:
        """Tokens of a chunk between spaces; None if white space at its edge ties it to its neighbours."""
        inner = chunk.removeprefix(" ")
        if not inner or inner[0].isspace() or inner[-1].isspace():
            return None
        return self._pieces(chunk)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        chunks = text.split(" ")
        try:
            return self.first[chunks[0]] + sum(map(self.later.__getitem__, islice(chunks, 1, None)))
        except TypeError:  # a run of white space somewhere: cut only at single spaces
            parts = self.CLEAN.split(text)
            return self._pieces(parts[0]) + sum(
                [self.later[p] if p.isalnum() else self._pieces(" " + p) for p in islice(parts, 1, None)])

    def count(self, text: str) -> int:
        if self.cutter is None or "<|" not in text:
            return self.plain(text)
        parts = self.cutter.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@kept
def token_counter(path: str) -> TokenCounter:
    """One counter for each worker process; the proof of whole tokens runs once in it."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of ``docs`` (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens. Special strings in a text count as one token each. Repeated rows
    come out repeated, a null doc_id stays null, an empty table gives none, other columns are left out. Whole texts
    are counted; a pre-token of any length is merged in n log n steps.
    """
    docs = narrowed(docs, doc_id="long", text="string")

    def run(batches):
        counter = token_counter(path)
        for batch in sliced(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            tokens = [counter.count(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
