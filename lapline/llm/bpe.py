"""Byte-pair encoding as a deterministic automaton, and its operator over a table of texts.

The automaton is compiled merge by merge. Its states are the tokens (the state after a token), its arcs the tokens
that may follow. The gadget of merge ``u v -> w`` adds state ``w``, which leaves as ``v`` left at that moment and is
entered wherever ``u`` was entered from a place that could go on to ``v``, then removes arc ``v`` from state ``u``.
After the last gadget exactly one path spells each word, and it is the encoding. Arcs are kept as what each gadget
changed (``left``, ``right``, ``made``, ``cut``): a table entry is worked out from them once and remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from lapline.llm.shared import Memo, kept, narrowed, sliced

#: Letters of the tables: a byte letter lies below LAST, which marks the last of a word; a state is shifted above both.
LAST, SHIFT = 1 << 9, 10
#: Bits of a token's id in the key of an arc.
SIDE = 24
#: Transitions that the table has at most.
ROOM = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


LETTERS = byte_letters()
LETTER_TABLE = "".join(LETTERS)


class MergeAutomaton:
    """Compiled merges; ``walk`` gives the tokens of one pre-split word."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.ids, self.suffix = vocabulary, suffix
        self.names = {i: name for name, i in vocabulary.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        low = (1 << SIDE) - 1
        self.arcs = Memo(lambda pair: self._arc(pair >> SIDE, pair & low, len(merges)), 250_000)
        self.live = {i for name, i in vocabulary.items() if len(name.removesuffix(suffix) if suffix else name) == 1}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])
        own = len(suffix)
        self.whole = {name[:len(name) - own]: i for name, i in vocabulary.items() if i in self.live and
                      name.endswith(suffix)}
        self._tables()

    def _tables(self) -> None:
        """States of the spelling: each is the longest end of what was read that begins a token. ``go`` has the next
        state by state and letter, ``back`` the next shorter end where it has none, ``ending`` the tokens that end in
        a state (size, token), the longest first. The last letter of a word is a letter of its own."""
        go: dict[int, int] = {}
        parents, letters, tokens = [0], [0], [-1]
        for name, i in self.ids.items():
            if i in self.live:
                state = 0
                for letter in self._letters(name.removesuffix(self.suffix), name.endswith(self.suffix)):
                    to = go.get(state << SHIFT | letter)
                    if to is None:
                        to = go[state << SHIFT | letter] = len(parents)
                        parents.append(state)
                        letters.append(letter)
                        tokens.append(-1)
                    state = to
                tokens[state] = i
        depth = [0] * len(parents)
        for state in range(1, len(parents)):  # a state comes after its parent
            depth[state] = depth[parents[state]] + 1
        back, ending = [0] * len(parents), [()] * len(parents)
        for state in sorted(range(1, len(parents)), key=depth.__getitem__):
            if depth[state] > 1:
                end, letter = back[parents[state]], letters[state]
                while end and end << SHIFT | letter not in go:
                    end = back[end]
                back[state] = go.get(end << SHIFT | letter, 0)
            ending[state] = ending[back[state]]
            if tokens[state] >= 0:
                ending[state] = ((depth[state], tokens[state]), *ending[state])
        # a state is its number shifted above the letters, so that state | letter is the place in the table
        self.go = {place: to << SHIFT for place, to in go.items()}
        self.back = {state << SHIFT: to << SHIFT for state, to in enumerate(back)}
        self.ending = {state << SHIFT: places for state, places in enumerate(ending)}
        self.sizes = {token: size for places in ending for size, token in places}

    def _letters(self, word: str, ends: bool) -> list[int]:
        out = list(map(ord, word))
        if self.suffix and ends:
            out[-1] |= LAST
        return out

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if max(self.made.get(u, -1), self.made.get(v, -1)) >= rank:
            raise ValueError("a merge uses a token that a later merge makes")
        if u in self.live and v in self.live and self._arc(u, v, rank):
            self.live.add(w)
        self.left[w], self.right[w], self.made[w], self.cut[u, v] = u, v, rank, rank

    def _arc(self, x: int, y: int, at: int) -> bool:
        """Whether state ``x`` has arc ``y`` just before gadget ``at``."""
        made, cut = self.made, self.cut
        while True:
            if cut.get((x, y), at) < at:
                return False
            made_x, made_y = made.get(x, -1), made.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:  # state x left as its right part did
                at, x = made_x, self.right[x]
            elif made_y > made_x:  # arc y was laid beside that of its left part
                if x == self.left[y] == self.right[y]:  # of u u u the first two merge
                    return False
                at, y = made_y, self.left[y]
            else:
                at, x, y = made_x, self.right[x], self.left[y]

    def walk(self, word: str) -> list[int]:
        """The one path that spells ``word`` (in byte letters), by one transition for each letter.

        A part of the path is the path of what it spells, so after each letter just one of the tokens that end there
        has an arc from the state reached before it; nothing is tried again.
        """
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        go, ending, arcs = self.go, self.ending, self.arcs
        last = [0]  # after each letter the token that ends there
        state = at = 0
        for letter in self._letters(word, True):
            to = go.get(state | letter)
            if to is None:
                to = self._further(state, letter)
            state = to
            at += 1
            for size, token in ending[state]:
                if size == at or arcs[last[-size] << SIDE | token]:
                    break
            last.append(token)
        path, sizes = [], self.sizes
        while at:
            token = last[at]
            path.append(token)
            at -= sizes[token]
        return path[::-1]

    def _further(self, state: int, letter: int) -> int:
        """The state after ``letter`` by way of shorter ends; the table keeps it while it has room."""
        go, short = self.go, state
        while (to := go.get(short | letter)) is None:
            if not short:
                raise ValueError("a letter that no token spells")
            short = self.back[short]
        if len(go) < ROOM:
            go[state | letter] = to
        return to


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def compiled(spec: dict) -> MergeAutomaton:
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")


class WordEncoder:
    """Encoder of a word-end vocabulary: lower case, white space dropped, pieces split by the file's own pattern.

    White space never lies in a piece, so the tokens of a text are those of its stretches between white space, one
    after the other; special strings are cut out of a stretch first, as the vocabulary's own library does. Which
    characters are letters, how they compose and what their lower case is differs between versions of Unicode, so
    outside of ASCII the library's own normaliser and pattern say it; ASCII is the same in all.
    """

    #: What the pattern's \\s takes; str.split() also splits at U+001C to U+001F, which are symbols here.
    SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
    ODD = re.compile("[\x1c-\x1f]")
    #: Letters that compose with nothing among them and have one lower case in every version of Unicode.
    STEADY = re.compile("[A-Za-zÀ-ÖØ-öø-įА-яЁёぁ-ゖァ-ヺ一-龥]+").fullmatch

    def __init__(self, path: str):
        spec = load(path)
        self.automaton = compiled(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        ascii_pattern = pattern.replace(r"[\p{L}]+", "[a-z]+").replace(r"[\p{N}]", "[0-9]").replace(
            r"[^\s\p{L}\p{N}]+", r"[^\t-\r a-z0-9]+")
        self.ascii_pieces = re.compile(ascii_pattern).findall
        self.words = Memo(self._word, 400_000)
        self.names = {**self.automaton.names, **{i: text for text, i in self.special.items()}}

    def _word(self, piece: str) -> tuple[int, ...]:
        if not (piece.isascii() and piece.isprintable()):
            piece = codecs.charmap_decode(piece.encode("utf-8", "replace"), "strict", LETTER_TABLE)[0]
        return tuple(self.automaton.walk(piece))

    def stretch(self, chunk: str) -> Sequence[int]:
        """Ids of a stretch without white space."""
        if "<|" in chunk:
            out = []
            for part in self.cutter.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(chunk)

    def _plain(self, chunk: str) -> Sequence[int]:
        words = self.words
        core, sign = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,;:!?" else (chunk, "")
        if self.STEADY(core):
            return words[core.lower()] + words[sign] if sign else words[core.lower()]
        if not chunk.isascii():
            return [i for piece, _ in self.split(self.normal(chunk)) for i in words[piece]]
        return [i for piece in self.ascii_pieces(chunk.lower()) for i in words[piece]]

    def stretches(self, text: str) -> list[str]:
        if self.ODD.search(text):
            return [c for c in self.SPACE.split(text) if c]
        return text.split()


@kept
def word_encoder(path: str) -> WordEncoder:
    """One compiled encoder for each worker process."""
    return WordEncoder(path)


def encode_texts(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode the text of each row of ``docs`` (doc_id, text).

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids and the decoded text. A null
    or empty text has no ids. Rows are taken one by one: repeated rows come out repeated, a null doc_id stays null,
    an empty table gives none, other columns are left out. Whole texts are encoded, however long.
    """
    docs = narrowed(docs, doc_id="long", text="string")
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        encoder = word_encoder(path)

        def labels(chunk):
            ids = encoder.stretch(chunk)
            return " ".join(map(str, ids)), " ".join([encoder.names[i] for i in ids])

        memo = Memo(labels, 250_000)
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [memo[chunk] for chunk in encoder.stretches(text or "")]
                ids, decoded = " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])
                n = ids.count(" ") + 1 if ids else 0
                row = [doc_id, n, hashlib.sha256(ids.encode()).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + ([list(map(int, ids.split())), decoded] if keep_ids else []))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][:len(names)]
    return docs.mapInArrow(run, fields)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Decoded text of each row of ``rows`` (doc_id, ids): the arc labels in turn, joined by one space.

    A null or empty list decodes to an empty text; a null or unknown id has no label and is left out.
    """
    rows = narrowed(rows, doc_id="long", ids="array<int>")

    def run(batches):
        names = word_encoder(path).names
        for batch in batches:
            texts = [" ".join([names[i] for i in ids or () if i in names]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def op4_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
