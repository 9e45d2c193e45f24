"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a value between them that is at most r/2 bits from each. So every distinct
fingerprint emits all variants within half the radius, variants are shuffled, and fingerprints that meet on one are
linked. A variant has at most as many members as a ball has values (65 at radius 2), whatever the table holds.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lapline.llm.components import components
from lapline.llm.shared import Scratch

#: Seed of the shingles' hash, shingles whose bits are added up at once, texts that a worker holds as Python values.
SEED, BLOCK, SLICE = 42, 1 << 16, 256


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits of a text: each is 1 if set in over half the hashes of its ``words``-word shingles, repeats included.

    A-Z in lower case, words cut at space and U+0009 to U+000D. With fewer words the whole sequence is one shingle;
    null, empty and blank texts have the fingerprint 0.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    data, width = b" ".join(found), min(words, len(found))
    starts = [0, *accumulate(len(word) + 1 for word in found)]
    spans = map(slice, starts, (end - 1 for end in starts[width:]))
    count = len(found) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, spans), repeat(SEED)), "<u8", count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, BLOCK):
        part = hashes[start:start + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"),
                       F.col("`text`").cast("string").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                bits = np.array([fingerprint(text, words) for text in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))],
                                                 ["doc_id", "fingerprint"])

    return docs.mapInArrow(run, "doc_id long, fingerprint long")


def ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` of 64 bits as longs, those of fewer bits first."""
    masks = [sum(1 << bit for bit in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [mask - 2**64 if mask >= 2**63 else mask for mask in masks]


def meetings(sets: DataFrame, radius: int = 2) -> DataFrame:
    """One row for each of ``sets`` (fingerprint, n) and variant on which it meets others.

    ``hub`` is the smallest fingerprint within half the radius (rounded down) of the variant, ``others`` the sum of n
    over the variant's other fingerprints. Each member is at most ``radius`` from the hub, so stars round the hubs
    join what all pairs would join.
    """
    outer, inner = ball(-(-radius // 2)), len(ball(radius // 2))
    variants = sets.select(
        "fingerprint", "n", F.posexplode(F.array(*map(F.lit, outer))).alias("place", "mask")).select(
        F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint", "n",
        (F.col("place") < inner).alias("inner"))
    same = Window.partitionBy("variant")
    return variants.select(
        "fingerprint", "n", F.count("*").over(same).alias("members"), F.sum("n").over(same).alias("all"),
        F.min(F.when(F.col("inner"), F.col("fingerprint"))).over(same).alias("hub")).where(
        "members > 1 and hub is not null").select("fingerprint", "hub", (F.col("all") - F.col("n")).alias("others"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text).

    Rows link whose fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id that links
    reach. At the radius of 2 there is also n_links, the number of other rows linked: fingerprints one or two bits
    apart meet on exactly two variants, so it is half of what they meet, and its own copies.

    Equal fingerprints are one before variants are made, so copies cost nothing. Null, empty and blank texts have the
    fingerprint 0 and link like any other. Repeated rows come out repeated. Rows without doc_id link too and come out
    with the component of their fingerprint, null if no row of it has a doc_id. An empty table gives none; other
    columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, words), "rows")
    sets = scratch.write(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "sets")
    met = scratch.write(meetings(sets, radius), "met")
    pairs = met.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("hub"))) <= radius).select(
        F.col("fingerprint").alias("a"), F.col("hub").alias("b"))
    found = components(scratch, pairs, "links").join(sets, F.col("node") == F.col("fingerprint"))
    found = scratch.write(found.select("fingerprint", "root", "least"), "found")
    roots = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(roots, "root").select("fingerprint", "component_id")
    twice = met.groupBy("fingerprint").agg(F.sum("others").alias("twice"))
    classes = sets.join(known, "fingerprint", "left").join(twice, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id"),
        (F.expr("coalesce(twice, 0) div 2") + F.col("n") - 1).alias("n_links"))
    # written, so that the rows of a very common fingerprint meet a plain table and are split like any skewed key
    classes = scratch.write(classes, "classes")
    out = rows.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
    return out if radius == 2 else out.drop("n_links")


def op12_simhash_ball(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
