"""Exact Jaccard join of documents on word n-grams: size-banded tiles, hashed bitmaps, sorted arrays.

Two sets whose symmetric difference is at most d agree on one of any d+1 parts of the hash space. Sizes are banded;
a band fixes d, and a tile is one band, one part and the hash of a set's n-grams in that part. Only sets that meet in
a tile can link. In a tile each set is first held against one hub, which is enough where all link; tiles where some
don't are compared whole, in blocks: the bits in which two bitmaps differ bound the overlap from above, and only
pairs that the bound lets through come to the exact intersection of their sorted arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapline.llm.components import components
from lapline.llm.shared import Memo, Scratch, forget, narrowed, sliced, small_batches

#: Prime number of slots of the filter that spares documents without candidates a second reading (1 MB of bits).
SLOTS = 8_388_593
BITMAP_BYTES = 512
#: Sets in a block of a tile that is compared whole.
BLOCK = 256
#: N-grams whose presence in two blocks is multiplied at once (16 MB).
COLUMNS = 8192
#: Keys of a task that are combined at once, words whose hashes are kept.
FLUSH, WORDS = 1_000_000, 100_000
#: Rows up to which a table of two longs is broadcast (16 MB).
SMALL = 1_000_000
NAMES = ["kind", "part", "a", "b", "c"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser by shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Measure:
    """What counts as a link: n-grams of ``words`` words, and num / den of the union in common."""

    words: int
    num: int
    den: int

    def slack(self, both: int) -> int:
        """The largest symmetric difference that two sets of ``both`` n-grams together may have."""
        return both * (self.den - self.num) // (self.den + self.num)

    def grams(self, text: str | None, memo: Memo) -> np.ndarray:
        """Distinct n-grams as sorted hashes; A-Z in lower case, words cut at space and U+0009 to U+000D."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        count = len(words) - width + 1
        out = hashes[:count] + np.uint64(width)
        for k in range(1, width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count])
        return np.unique(mix(out))

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(lowest size, d) of the bands in which a set of ``size`` may link with another set.

        A band holds the pairs whose smaller set is from its lowest size up to the next band's; the larger may lie
        above it.
        """
        out, low = [], 1
        while low <= size:
            following = max(low + 1, low * 7 // 5)
            smaller = following - 1
            larger = smaller * self.den // self.num
            if size <= larger:
                slack = self.slack(smaller + larger)
                if slack:  # else only equal sets link, and those are one already
                    out.append((low, slack))
            low = following
        return out

    def tiles(self, grams: np.ndarray) -> np.ndarray:
        """Tile keys of a set."""
        keys = []
        for low, slack in self.bands(len(grams)):
            parts = slack + 2 + slack // 8
            for turn in range(8):
                spread = mix(grams + np.uint64((turn + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
                part = (spread % np.uint64(parts)).astype(np.int64)
                full = np.bincount(part, minlength=parts) > 0
                # sums modulo 2**64 from two halves: each fits a double exactly
                bits = mix(spread)
                high = np.bincount(part, (bits >> np.uint64(32)).astype(np.float64), parts)
                low_half = np.bincount(part, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), parts)
                sums = (np.fmod(high, 2.0**32).astype(np.uint64) << np.uint64(32)) + low_half.astype(np.uint64)
                names = np.arange(parts, dtype=np.uint64) + np.uint64((low << 24) + (turn << 20) + (low << 40))
                keys.append(mix(mix(names) + sums)[full])
                # each full part that differs takes one of the d differences: with more full parts than that one agrees
                if full.sum() > slack:
                    break
            else:
                keys.append(mix(grams ^ np.uint64(low)))
        return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes())


def bitmap(grams: np.ndarray) -> bytes:
    """One bit for each n-gram, by hash; two sets differ in at least as many n-grams as their bitmaps in bits."""
    bits = np.zeros(BITMAP_BYTES * 8, np.uint8)
    bits[(mix(grams + np.uint64(77)) % np.uint64(BITMAP_BYTES * 8)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sketches(docs: DataFrame, measure: Measure) -> DataFrame:
    """One reading of all texts: a row per document (kind 0: doc_id, set, size) and rows for sets and tiles.

    Sets that meet in a task are combined here: a tile sends one row per task (kind 1: its first set), however many
    sets it has; where it has several, each of them is a row too (kind 2: key, set, and the first set, null if it is
    that one). ``part`` says where a row goes: kind 1 by its tile's key, the others anywhere.
    """
    def combined(keys: list, sets: list):
        key, own = np.concatenate(keys), np.concatenate(sets)
        order = np.lexsort((own.view(np.int64), key))
        key, own = key[order], own[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        hub = own[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
        key, own, hub, first = key[~again], own[~again], hub[~again], first[~again]
        joined = np.zeros(len(key), bool)  # tiles with several sets
        joined[:-1] = ~first[1:]
        joined |= ~first
        for kind, chosen in ((1, first), (2, joined)):
            keys_, sets_, hubs = key[chosen], own[chosen], hub[chosen]
            for start in range(0, len(keys_), 100_000):
                at = slice(start, start + 100_000)
                n = len(keys_[at])
                same = np.ones(n, bool) if kind == 1 else sets_[at] == hubs[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, kind, np.int8)),
                     signed(keys_[at] if kind == 1 else mix(keys_[at] ^ sets_[at])),
                     pa.nulls(n, pa.int64()) if kind == 1 else signed(keys_[at]), signed(sets_[at]),
                     pa.array(hubs[at].view(np.int64), mask=same)], NAMES)

    def run(batches):
        forget()
        memo, seen = Memo(xxhash.xxh64_intdigest, WORDS), set()
        keys, sets, held, seen_rows = [], [], 0, 0
        for batch in sliced(batches):
            own, sizes = [], []
            for text in batch.column(1).to_pylist():
                grams = measure.grams(text, memo)
                sizes.append(len(grams))
                if not len(grams):
                    own.append(None)
                    continue
                name = set_key(grams)
                own.append(name - 2**64 if name >= 2**63 else name)
                if name in seen:
                    continue
                seen.add(name)
                found = measure.tiles(grams)
                if len(found):
                    keys.append(found)
                    sets.append(np.full(len(found), name, np.uint64))
                    held += len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(batch.num_rows, np.int8)),
                 signed(mix(np.arange(seen_rows, seen_rows + batch.num_rows, dtype=np.uint64) + np.uint64(len(keys)))),
                 batch.column(0), pa.array(own, pa.int64()), pa.array(sizes, pa.int64())], NAMES)
            seen_rows += batch.num_rows
            if held >= FLUSH:
                yield from combined(keys, sets)
                keys, sets, held = [], [], 0
                seen.clear()
        if keys:
            yield from combined(keys, sets)

    return docs.mapInArrow(run, "kind byte, part long, a long, b long, c long")


def slot_bits(ids: DataFrame) -> np.ndarray:
    """Bits of the slots that ``ids`` (doc_id) fall in: at most SLOTS / 64 rows come to the driver."""
    slot = F.pmod("doc_id", F.lit(SLOTS))
    words = ids.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    out = np.zeros(SLOTS // 64 + 1, np.int64)
    for word, bits in words:
        out[word] = bits
    return out.view(np.uint64)


def arrays_of(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """(set, size, bits, grams) of the sets in ``wanted`` (doc_id, set): a second reading, of their documents only."""
    bits = docs.sparkSession.sparkContext.broadcast(slot_bits(wanted))

    def run(batches):
        forget()
        memo, held = Memo(xxhash.xxh64_intdigest, WORDS), bits.value
        for batch in sliced(batches):
            batch = batch.filter(pa.array([
                i is not None and bool(int(held[(i % SLOTS) // 64]) >> (i % SLOTS) % 64 & 1)
                for i in batch.column(0).to_pylist()], pa.bool_()))
            rows = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = measure.grams(text, memo)
                if len(grams):
                    name = set_key(grams)
                    row = (doc_id, name - 2**64 if name >= 2**63 else name, len(grams), bitmap(grams), grams.tobytes())
                    for column, value in zip(rows, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                ["doc_id", "set", "size", "bits", "grams"])

    found = docs.mapInArrow(run, "doc_id long, set long, size long, bits binary, grams binary")
    return found.join(wanted, ["doc_id", "set"], "left_semi").drop("doc_id")


def linked(pairs: DataFrame, arrays: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) that link, by the exact intersection of their sorted arrays."""
    left = arrays.select(F.col("set").alias("b"), F.col("grams").alias("grams_b"))
    right = arrays.select(F.col("set").alias("a"), F.col("grams").alias("grams_a"))

    def run(batches):
        forget()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * measure.den < len(large) * measure.num:
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                keep.append(common * measure.den >= (len(x) + len(y) - common) * measure.num)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "grams_a", "grams_b")
    return joined.mapInArrow(run, "a long, b long")


def small_enough(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most SMALL rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def compared_whole(scratch: Scratch, tiles: DataFrame, stars: DataFrame, tied: DataFrame, roots: DataFrame,
                   arrays: DataFrame, measure: Measure, nearest: bool, turn: str) -> DataFrame:
    """Pairs of sets that may link: of tiles whose sets aren't all in one component yet, those that the bitmaps allow.

    ``stars`` (a, b) are the pairs of members and hubs, ``tied`` (key, a, b) those between tasks with their tiles.
    With ``nearest`` only the nearest set of another component is given for each set of a block.
    """
    root_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    root_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    apart = scratch.write(
        stars.join(root_a, "a", "left").join(root_b, "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), f"apart_{turn}")
    within = tiles.where("c is not null").select(F.col("a").alias("key"), F.greatest("b", "c").alias("a"),
                                                 F.least("b", "c").alias("b"))
    keys = scratch.write(within.unionByName(tied).join(small_enough(apart), ["a", "b"], "left_semi")
                         .select("key").distinct(), f"split_keys_{turn}")
    members = tiles.select(F.col("a").alias("key"), F.col("b").alias("set")).join(
        small_enough(keys), "key", "left_semi").distinct()
    members = scratch.write(
        members.join(roots.withColumnRenamed("node", "set"), "set", "left")
        .join(arrays.select("set", "size", "bits"), "set")
        .select("key", "set", F.coalesce("root", "set").alias("root"), "size", "bits"), f"members_{turn}")
    blocks = scratch.write(members.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 2").select(
        "key", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), f"blocks_{turn}")
    # block i meets blocks i, i+1, ...: each set goes once to every block and is held against those of that block
    placed = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "root",
        "size", "bits")

    def run(rows: pa.Table) -> pa.Table:
        block, name, root, size = (rows[c].to_numpy() for c in ("block", "set", "root", "size"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(name), -1)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for k in one:
            differ = np.bitwise_count(bits[two] ^ bits[k]).sum(axis=1)
            both = size[two] + size[k]
            fits = (root[two] != root[k]) & (differ.astype(np.int64) <= both * (measure.den - measure.num)
                                            // (measure.den + measure.num))
            hits = np.flatnonzero(fits & ((name[two] < name[k]) | (i != j)))
            if nearest and len(hits):
                hits = hits[differ[hits].argmin()][None]
            hits = name[two[hits]]
            out_a.append(np.maximum(hits, name[k]))
            out_b.append(np.minimum(hits, name[k]))
        return pa.table({"a": np.concatenate(out_a) if out_a else np.empty(0, np.int64),
                         "b": np.concatenate(out_b) if out_b else np.empty(0, np.int64)})

    return placed.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def grouped(scratch: Scratch, docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, set, n_shingles) of all documents, arrays of the sets that may link, and (node, root) of those
    that do."""
    # of the tiles with one set in one task only, which are nearly all, no row is written
    with small_batches(scratch.spark):
        sketch = scratch.write(
            sketches(docs, measure).selectExpr("*", "min(b) over (partition by kind, part) as low",
                                               "max(b) over (partition by kind, part) as high")
            .where("kind <> 1 or low <> high").drop("high"), "sketch")
    rows = sketch.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("set"),
                                           F.col("c").alias("n_shingles"))
    tiles = sketch.where("kind > 0").selectExpr("if(kind = 1, part, a) as a", "b", "c")
    # the smallest of the sets that tasks sent on is the hub of a tile
    tied = scratch.write(sketch.where("kind = 1 and b <> low").selectExpr("part as key", "b as a", "low as b"), "tied")
    stars = scratch.write(
        tiles.where("c is not null").select(F.greatest("b", "c").alias("a"), F.least("b", "c").alias("b"))
        .unionByName(tied.select("a", "b")).distinct(), "stars")
    ends = stars.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = scratch.write(rows.where("set is not null and doc_id is not null").groupBy("set")
                           .agg(F.min("doc_id").alias("doc_id")).join(ends, "set"), "wanted")
    with small_batches(scratch.spark):
        arrays = scratch.write(arrays_of(docs, wanted, measure), "arrays")
        links = scratch.write(linked(stars, arrays, measure), "links")
    roots = scratch.write(components(scratch, links, "first"), "first_roots")
    checked = stars
    # sets that don't link with their hub find their nearest neighbour in another component first, which joins most
    # of what belongs together; the last turn takes all pairs that are left, so that no link is missed
    for turn in ("near", "nearer", "all"):
        pairs = scratch.write(compared_whole(
            scratch, tiles, stars, tied, roots, arrays, measure, turn != "all", turn), f"pairs_{turn}")
        if not pairs.limit(1).count():
            break
        fresh = scratch.write(pairs.join(checked, ["a", "b"], "left_anti"), f"fresh_{turn}")
        checked = checked.unionByName(fresh)
        with small_batches(scratch.spark):
            later = scratch.write(linked(fresh, arrays, measure), f"later_{turn}")
        scratch.drop(f"members_{turn}")
        if later.limit(1).count():
            links = links.unionByName(later)
            roots = scratch.write(components(scratch, links, turn), f"roots_{turn}")
    return rows, arrays, roots


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Two rows link when their sets of ``words``-word n-grams have num / den of their union in common, or more;
    component_id is the smallest doc_id that a row reaches by links, its own included. A text of fewer words is one
    n-gram; a null text or one without words is empty, has 0 n-grams and links with nothing. Equal sets are one from
    the start, so copies and repeated rows cost no pairs. A row without doc_id shares the component of rows with an equal
    set; a set that only such rows have links with nothing, and its component_id is null. An empty table gives no row; other columns are left out. Whole
    texts are read and no link is lost: every pair above the limit meets in a tile.
    """
    measure = Measure(words, num, den)
    docs = narrowed(docs, doc_id="long", text="string")
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows, _, roots = grouped(scratch, docs, measure)
    scratch.drop("arrays")
    full = rows.where("set is not null").join(roots.withColumnRenamed("node", "set"), "set", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "set").alias("root"))
    full = scratch.write(full, "full")
    named = scratch.write(full.groupBy("root").agg(F.min("doc_id").alias("component_id")), "named")
    empty = scratch.write(rows.where("set is null").select("doc_id", "n_shingles"), "empty")
    scratch.drop("sketch", "tied", "stars", "wanted", "links")
    return full.join(named, "root").select("doc_id", "n_shingles", "component_id").unionByName(
        empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def all_links(rows: pa.Table, measure: Measure):
    """(one, two, links) of a table of two blocks of a component: the places of their sets, and which of them link."""
    block, size = rows["block"].to_numpy(), rows["size"].to_numpy()
    one, two = (np.flatnonzero(block == rows[c][0].as_py()) for c in ("i", "j"))
    grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["grams"].combine_chunks()]
    names, place = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(grams)), size)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(one), len(two)), np.float32)  # whole numbers below 2**24 are exact
    for start in range(0, len(names), COLUMNS):
        low, high = np.searchsorted(place, (start, start + COLUMNS))
        has = np.zeros((len(grams), min(COLUMNS, len(names) - start)), np.float32)
        has[owner[low:high], place[low:high] - start] = 1
        common += has[one] @ has[two].T
    common = common.astype(np.int64)
    links = common * measure.den >= (size[one][:, None] + size[two][None, :] - common) * measure.num
    if rows["i"][0].as_py() == rows["j"][0].as_py():
        links = np.triu(links, 1)
    return one, two, links


def blocks_of(scratch: Scratch, rows: DataFrame, arrays: DataFrame, roots: DataFrame) -> DataFrame:
    """The sets of each component in blocks, once for every block that theirs meets: a link lies inside a component, so
    each pair of sets meets in one group of (root, i, j) only."""
    copies = rows.where("set is not null and doc_id is not null").groupBy("set").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    members = scratch.write(
        roots.distinct().withColumnRenamed("node", "set").join(arrays.select("set", "size", "grams"), "set")
        .join(copies, "set"), "linked_members")
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "doc_id",
        "copies", "size", "grams")


def link_counts(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, n_links and n_near of each row of ``docs`` (doc_id, text), by the links of near_duplicates.

    n_links is the number of other rows with a doc_id that the row links with, copies of its text included; n_near
    is the number of different sets among them, its own not counted. All pairs of a component are compared exactly
    and counted inside tasks, each in one task. Rows without n-grams have 0 links.
    """
    measure = Measure(words, num, den)
    scratch = Scratch(docs.sparkSession, "links")
    rows, arrays, roots = grouped(scratch, narrowed(docs, doc_id="long", text="string"), measure)

    def run(rows: pa.Table) -> pa.Table:
        one, two, links = all_links(rows, measure)
        name, copies = rows["set"].to_numpy(), rows["copies"].to_numpy()
        return pa.table({"set": np.concatenate([name[one], name[two]]),
                         "others": np.concatenate([links @ copies[two], copies[one] @ links]).astype(np.int64),
                         "near": np.concatenate([links.sum(axis=1), links.sum(axis=0)]).astype(np.int64)})

    counts = blocks_of(scratch, rows, arrays, roots).groupBy("root", "i", "j").applyInArrow(
        run, "set long, others long, near long").groupBy("set").agg(F.sum("others").alias("others"),
                                                                    F.sum("near").alias("near"))
    own = rows.where("set is not null").groupBy("set").agg(F.count("doc_id").alias("copies"))
    sums = own.join(counts, "set", "left")
    itself = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    return rows.join(sums, "set", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set").isNull(), F.lit(0)).otherwise(
            F.col("copies") - itself + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))


def link_pairs(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_a, doc_b) of every two different sets that link, doc_a < doc_b: each set by its smallest doc_id, once."""
    measure = Measure(words, num, den)
    scratch = Scratch(docs.sparkSession, "links")

    def run(rows: pa.Table) -> pa.Table:
        one, two, links = all_links(rows, measure)
        a, b = np.nonzero(links)
        ids = rows["doc_id"].to_numpy()
        a, b = ids[one[a]], ids[two[b]]
        return pa.table({"doc_a": np.minimum(a, b), "doc_b": np.maximum(a, b)})

    rows, arrays, roots = grouped(scratch, narrowed(docs, doc_id="long", text="string"), measure)
    return blocks_of(scratch, rows, arrays, roots).groupBy("root", "i", "j").applyInArrow(run, "doc_a long, doc_b long")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) END AS g
  FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (
  SELECT doc_id, x FROM (
    SELECT e.doc_id, e.x, n.n_shingles,
      row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.x) AS r
    FROM e JOIN f USING (x) JOIN n USING (doc_id))
  WHERE r <= n_shingles - (9 * n_shingles + 9) // 10 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id),
l AS (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 10 * len(list_intersect(x.g, y.g)) >= 9 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))),
r AS (
  WITH RECURSIVE reach(d, o) AS (
    SELECT doc_id, doc_id FROM n
    UNION
    SELECT reach.d, k.o FROM reach JOIN (SELECT a AS d, b AS o FROM l UNION ALL SELECT b, a FROM l) k
      ON reach.o = k.d)
  SELECT d, min(o) AS component_id FROM reach GROUP BY d)
SELECT n.doc_id, n.n_shingles, r.component_id FROM n JOIN r ON r.d = n.doc_id
"""
