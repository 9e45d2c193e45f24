"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapline.llm.bpe import word_encoder
from lapline.llm.shared import Memo, Scratch, narrowed, sliced

PIECES_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """First bin, in order of opening, that still holds a length: each node keeps the larger room of its two."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = array("l", [capacity]) * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for ``length``; its room shrinks by it."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        had = room[node]
        room[node] = had - length
        found = node - self.size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths come in decreasing order and none is above ``capacity``."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = [], []
    for length in lengths:
        found, had = tree.place(length)
        bins.append(found)
        offsets.append(capacity - had)
    return bins, offsets


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: full ones of ``capacity`` ids and the rest, each with the CRC of its ids."""

    def run(batches):
        encoder = word_encoder(path)
        memo = Memo(lambda chunk: array("I", encoder.stretch(chunk)).tobytes(), 400_000)
        end = array("I", [end_id]).tobytes()
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join([*map(memo.__getitem__, encoder.stretches(text or "")), end])
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 50_000) -> DataFrame:
    """Pack the ids of all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    A document's ids are those of the vocabulary at ``path`` and then ``end_id``; only one longer than ``capacity``
    is cut. Its full pieces are sequences of their own; the rests are dealt by a hash into groups of about
    ``group_pieces`` and packed first-fit decreasing in each, which leaves at most a few bins of a group unfilled.
    The number of groups grows with the input, so a group's size doesn't.

    Gives one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text
    is the end id alone. Repeated rows are packed each for itself; a null doc_id stays null; an empty table gives no
    row; other columns are left out. Pieces of one length are placed by doc_id, start and CRC.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(narrowed(docs, doc_id="long", text="string"), path, capacity, end_id), "pieces")
    count = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-count // group_pieces))
    # rows that are equal in all columns are told apart by a number of their own
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == capacity).select(
        *PIECES_NAMES, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).withColumn(
        "group", F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                             ("ids_crc32", "ascending"), ("row", "ascending")])
        bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), capacity)
        group = rows["group"][0].as_py()
        sequences = pa.array([2 * (bin_ * groups + group) for bin_ in bins], pa.int64())
        return rows.select(PIECES_NAMES).append_column("sequence_id", sequences).append_column(
            "offset", pa.array(offsets, pa.int64()))

    packed = rest.groupBy("group").applyInArrow(run, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
