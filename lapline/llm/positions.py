"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt into shards as they are read. A shard holds, for each term of the query items, its documents by
falling impact. For an item, positions of its lists are read from the top, all lists in turn; each document met is
looked up in all other lists at once (direct access), and its positions there count as seen too. The best position of a
list is the last before which all positions are seen, so what lies beyond the best positions bounds every document not
met. The search ends when that bound is strictly below the k-th score: an equal score could belong to a smaller
doc_id. Statistics are those of the whole table, so the best of all shards' best are the best of all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapline.llm.shared import Scratch

#: Postings of a shard, terms of the items that are searched for at once, texts held as Python values, parts in which
#: a task's results are merged first, positions of each list in the first turn.
SHARD, ASKED, SLICE, PARTS, FIRST = 4_000_000, 1_000_000, 256, 64, 16
#: Bits that hold the impact of a posting without its term's weight (below 1,000,000).
IMPACT_BITS = 20


def _letters() -> bytes:
    """For each byte its part in a term: digits, a-z and bytes from 0x80 as they are, A-Z in lower case, else space."""
    kept = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
    return bytes(low if low in kept else 32 for low in (ord(chr(b).lower()) if b < 128 else b for b in range(256)))


LETTERS = _letters()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def tallies(docs: DataFrame, names) -> DataFrame:
    """One reading of (doc_id, text). Kind 0, for each row with a term of ``names``: doc_id, n (all its terms with
    repeats), terms and their frequencies (each 4 bytes). Kind 1, for each task: the number of rows with a term at all,
    their terms with repeats, and the documents of each of ``names``."""

    def run(batches):
        places = {name: place for place, name in enumerate(names.value)}
        df, rows, total = np.zeros(len(places), np.int64), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(start, SLICE), ([], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = terms_of(text)
                    if not found:
                        continue
                    rows, total = rows + 1, total + len(found)
                    known = [place for place in map(places.get, found) if place is not None]
                    if known:
                        terms, tf = np.unique(np.array(known, np.int32), return_counts=True)
                        df[terms] += 1
                        for column, value in zip(out, (doc_id, len(found), terms.tobytes(),
                                                       tf.astype(np.int32).tobytes())):
                            column.append(value)
                yield batch_of(0, *out)
        held = np.flatnonzero(df)
        yield batch_of(1, [rows], [total], [held.astype(np.int32).tobytes()], [df[held].astype(np.int32).tobytes()])

    def batch_of(kind, *columns):
        types = pa.int64(), pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(columns[0]), pa.int8()), *map(pa.array, columns, types)],
            ["kind", "doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "kind byte, doc_id long, n long, terms binary, tf binary")


def document_counts(tallied: DataFrame) -> DataFrame:
    """term (its place) and df, from the rows of kind 1."""

    def run(batches):
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms, np.int32)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))],
                    ["term", "df"])

    parts = tallied.where("kind = 1").select("terms", "tf").mapInArrow(run, "term int, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """Postings of one shard as impact lists, and the same by document for direct access."""

    def __init__(self, weights: np.ndarray, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, parts: np.ndarray):
        """A posting is a term, a document (its place in ``ids``) and its part of the score without the weight."""
        order = np.argsort((terms.astype(np.int64) << IMPACT_BITS) + ((1 << IMPACT_BITS) - 1 - parts), kind="stable")
        sorted_terms = terms[order]
        self.ids, self.docs, self.scores = ids, docs[order], parts[order] * weights[sorted_terms]
        self.bounds = np.searchsorted(sorted_terms, np.arange(len(weights) + 1))
        self.places = np.argsort(self.docs, kind="stable").astype(np.int32)  # positions by document
        self.own_terms = sorted_terms[self.places]
        self.own_bounds = np.searchsorted(self.docs[self.places], np.arange(len(ids) + 1))
        self.seen = np.zeros(len(terms), bool)
        self.known = np.zeros(len(ids), bool)
        self.asked = np.zeros(len(weights), bool)
        self.met = 0  # documents met by all searches

    def search(self, terms: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best (scores, doc_ids) of ``best`` and this shard: higher scores first, of equals the smaller id."""
        low, high = self.bounds[terms], self.bounds[terms + 1]
        low, high = low[high > low], high[high > low]
        at, depth, step, met = low.copy(), 0, FIRST, []
        self.asked[terms] = True
        while True:
            # in turn: the next positions of every list that has some
            tops, ends = np.minimum(low + depth, high), np.minimum(low + depth + step, high)
            docs = self.docs[spread(tops, ends)]
            new = np.unique(docs[~self.known[docs]])
            if len(new):
                self.known[new] = True
                met.append(new)
                best = self._looked_up(new, k, best)
            depth, step = depth + step, step * 2
            bound = 0
            for i, (place, end) in enumerate(zip(at.tolist(), high.tolist())):
                if place < end:
                    if self.seen[place]:
                        gap = int(np.argmin(self.seen[place:end]))
                        place = place + gap if not self.seen[place + gap] else end
                        at[i] = place
                    if place < end:
                        bound += int(self.scores[place])
            if bound == 0 or (len(best[0]) == k and bound < best[0][-1]):
                break
        self.asked[terms] = False
        for x, y in zip(low.tolist(), high.tolist()):
            self.seen[x:y] = False
        for new in met:
            self.known[new] = False
            self.met += len(new)
        return best

    def _looked_up(self, new: np.ndarray, k: int, best):
        """Direct access to all lists of the item for documents ``new``."""
        for start in range(0, len(new), 8192):
            part = new[start:start + 8192]
            low, high = self.own_bounds[part], self.own_bounds[part + 1]
            flat = spread(low, high)
            keep = self.asked[self.own_terms[flat]]
            places = self.places[flat[keep]]
            self.seen[places] = True
            owner = np.repeat(np.arange(len(part)), high - low)[keep]
            firsts = np.searchsorted(owner, np.arange(len(part)))  # each met document has a posting of the item
            scores, ids = np.add.reduceat(self.scores[places], firsts), self.ids[part]
            if len(best[0]) == k:
                likely = scores >= best[0][-1]
                scores, ids = scores[likely], ids[likely]
            likely = scores > 0
            scores = np.concatenate([best[0], scores[likely]])
            ids = np.concatenate([best[1], ids[likely]])
            order = np.lexsort((ids, -scores))[:k]
            best = scores[order], ids[order]
        return best


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges from ``low`` to below ``high``, one range after the other."""
    each = high - low
    return np.arange(each.sum()) + np.repeat(low - np.cumsum(each) + each, each)


def searched(found: DataFrame, held, k: int) -> DataFrame:
    """item_id, doc_id, score: the ``k`` best documents of every task for every item. ``held`` is a broadcast of the
    items, the bounds of their terms, these terms, the terms' weights, and the number of documents and terms."""

    def run(batches):
        items, bounds, asked, weights, number, total = held.value
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        best = [nothing] * len(items)
        for rows in shards(batches):
            ids, n, terms, tf = rows
            each = [len(t) // 4 for t in terms]
            terms, tf = (np.frombuffer(b"".join(x), np.int32) for x in (terms, tf))
            size = 50 + np.array([50 * x * number // total for x in n], np.int64)
            docs = np.repeat(np.arange(len(ids), dtype=np.int32), each)
            parts = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * size[docs])
            shard = Shard(weights, np.array(ids, np.int64), terms, docs, parts)
            del docs, parts, terms, tf
            for place in range(len(items)):
                best[place] = shard.search(asked[bounds[place]:bounds[place + 1]], k, best[place])
        for item, (scores, docs) in zip(items.tolist(), best):
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(docs), pa.int64()), pa.array(docs), pa.array(scores)],
                    ["item_id", "doc_id", "score"])

    def shards(batches):
        rows, postings = ([], [], [], []), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for column, values in zip(rows, part.columns):
                    column.extend(values.to_pylist())
                postings += sum(len(t) // 4 for t in rows[2][-part.num_rows:])
                if postings >= SHARD:
                    yield rows
                    rows, postings = ([], [], [], []), 0
        if rows[0]:
            yield rows

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct item_id, term of (item_id, text)."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = sorted(set(terms_of(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    return items.mapInArrow(run, "item_id long, term binary").distinct()


def best_matches(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items``
    (item_id, text); scores above 0 only, equal scores by ascending doc_id.

    Terms are the runs of ASCII letters, digits and all characters from U+0080, A-Z in lower case, each term of an
    item once. With N rows that have a term, L their terms with repeats, n those of one row, df the rows holding a
    term and tf its occurrences in a row, a score sums w * ((10**9 * tf) div (1000 * tf + 20 * m)) where
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 50 + (50 * n * N) div L.

    Items are searched for in blocks of about a million terms, each block against all documents. Rows without doc_id
    take no part, nor do items without item_id; null and empty texts have no terms and aren't found. A doc_id that
    comes twice counts and is found twice; an item_id that comes twice is one item with the terms of both. Empty
    tables give no rows; other columns are left out.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "positions")
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"),
                       F.col("`text`").cast("string").cast("binary").alias("text")).where("doc_id is not null")
    items = items.select(F.col("`item_id`").cast("long").alias("item_id"),
                         F.col("`text`").cast("string").cast("binary").alias("text")).where("item_id is not null")
    asked = scratch.write(item_terms(items), "asked")
    blocks = -(-asked.count() // ASKED)
    found = [_block(scratch, docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k, block)
             for block in range(blocks)]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # no task gets all rows of an item: first the best of each part, then of these
    best = [F.col("score").desc(), F.col("doc_id")]
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*best)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(scratch: Scratch, docs: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame | None:
    """The best of each task for one block of items, a written table; None if nothing can be found."""
    context = docs.sparkSession.sparkContext
    rows = sorted((r["item_id"], bytes(r["term"])) for r in asked.collect())  # about ASKED rows
    names = sorted({term for _, term in rows})
    if not names:
        return None
    tallied = scratch.write(tallies(docs, context.broadcast(names)), f"tallies_{block}")
    number, total = tallied.where("kind = 1").agg(F.sum("doc_id"), F.sum("n")).first()
    if not total:
        return None
    df = np.zeros(len(names), np.int64)
    for row in document_counts(tallied).collect():
        df[row["term"]] = row["df"]
    weights = np.floor(1000 * np.log((2.0 * number + 2) / (2.0 * df + 1))).astype(np.int64)
    places = {name: place for place, name in enumerate(names)}
    items, lists = [], []
    for item, terms in itertools.groupby(rows, key=lambda row: row[0]):
        items.append(item)
        lists.append(np.array([places[term] for _, term in terms], np.int64))
    bounds = np.cumsum([0, *map(len, lists)])
    held = context.broadcast((np.array(items, np.int64), bounds, np.concatenate(lists), weights, number, total))
    found = scratch.write(searched(tallied.where("kind = 0").drop("kind"), held, k), f"found_{block}")
    scratch.drop(f"tallies_{block}")
    return found


def op13_best_position(spark, sf_dir: str) -> DataFrame:
    return best_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scores AS (
    SELECT item_id, doc_id, sum(
        w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total
    GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
