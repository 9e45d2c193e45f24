"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own centroids; a cell is a pair of centroids and lists
the vectors that fall to it. A query visits cells in order of the summed squared distance of its halves to the pair,
kept in a heap, until the cells seen hold enough vectors; all of those are ranked by the exact cosine.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapline.llm.shared import Scratch, narrowed

#: Rows of the index and queries that meet in one task, and queries in one matrix product.
ROWS, QUERIES, STEP = 20_000, 4096, 256
#: A length of vectors that no more rows have is indexed and searched in one task.
SMALL = 4096
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Halves:
    """Centroids of the two halves."""

    left: np.ndarray
    right: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each row's halves to the centroids."""
        at = self.left.shape[1]
        return tuple(
            np.maximum((part**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * part @ c.T, 0)
            for part, c in ((unit[:, :at], self.left), (unit[:, at:], self.right)))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        left, right = self.distances(unit)
        return left.argmin(axis=1) * len(self.right) + right.argmin(axis=1)


def centroids(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= count:
        return rows
    out = rows[np.random.default_rng(7).choice(len(rows), count, replace=False)].copy()
    for _ in range(rounds):
        near = (rows @ out.T - 0.5 * (out**2).sum(axis=1)).argmax(axis=1)
        for k in range(count):
            if (own := rows[near == k]).size:
                out[k] = own.mean(axis=0)
    return out


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as rows, and the same at length 1."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    top = np.abs(values).max(axis=1, keepdims=True)  # first to a largest component of 1: no square over- or underflows
    scaled = values / top
    return values, scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def visited(near_left: np.ndarray, near_right: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold ``enough`` vectors; empty cells are passed over."""
    left, right = near_left.argsort(kind="stable"), near_right.argsort(kind="stable")
    width, out, held = len(near_right), [], 0
    heap, seen = [(near_left[left[0]] + near_right[right[0]], 0, 0)], {(0, 0)}
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(left[i]) * width + int(right[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near_left[left[x]] + near_right[right[y]], x, y))
    return out


def best_of(queries: np.ndarray, ids: np.ndarray, probed: np.ndarray, rows: np.ndarray, units: np.ndarray,
            row_ids: np.ndarray, cells: np.ndarray, k: int):
    """(query, row id, cosine) of each query's ``k`` nearest among the rows of the cells it visits; rows by id. An id
    with several vectors counts by the best of them."""
    firsts = np.flatnonzero(np.diff(row_ids, prepend=row_ids[0] - 1))
    lengths = np.sqrt((rows**2).sum(axis=1))
    for start in range(0, len(queries), STEP):
        part = slice(start, start + STEP)
        own = queries[part]
        scaled = own / np.abs(own).max(axis=1, keepdims=True)
        rough = (scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))) @ units.T
        rough[~probed[part][:, cells]] = -np.inf
        rough[ids[part][:, None] == row_ids[None, :]] = -np.inf
        for q in range(len(own)):
            best = np.maximum.reduceat(rough[q], firsts)
            open_ = int((best > -np.inf).sum())
            if not open_:
                continue
            least = np.partition(best, -k)[-k] if open_ > k else -2.0
            found = np.flatnonzero(rough[q] >= least - 1e-9)  # products of a batch differ in the last digits
            score = (rows[found] * own[q]).sum(axis=1) / (lengths[found] * np.sqrt((own[q]**2).sum()))
            given: set[int] = set()
            for at in np.lexsort((row_ids[found], -score)):
                if (row := int(row_ids[found[at]])) not in given:
                    given.add(row)
                    yield int(ids[part][q]), row, float(score[at])
                    if len(given) == k:
                        break


def fitted(units: np.ndarray, halves: int) -> Halves:
    cut = max(1, units.shape[1] // 2)
    return Halves(centroids(units[:, :cut], halves), centroids(units[:, cut:], halves))


def wanted(rows: int, share: float, k: int) -> int:
    """How many vectors a query has to meet at least."""
    return max(int(np.ceil(share * rows)), 100 * k)


def found_table(found: list) -> pa.Table:
    columns = list(zip(*found)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                    ["query_id", "vec_id", "score"])


def searched_whole(every: int, k: int, halves: int, share: float, sample: int):
    """The same index over all rows of one length in one task."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("hash", "ascending")])
        ids = rows["vec_id"].to_numpy()
        values, units = unit_rows(rows["embedding"].combine_chunks())
        asked = np.flatnonzero(ids % every == 0)
        if not asked.size:
            return found_table([])
        index = fitted(units[rows["hash"].to_numpy().argsort(kind="stable")[:sample]], halves)
        cells = index.cells(units)
        counts = np.bincount(cells, minlength=len(index.left) * len(index.right))
        probed = np.zeros((len(asked), len(counts)), bool)
        for place, (left, right) in enumerate(zip(*index.distances(units[asked]))):
            probed[place, visited(left, right, counts, wanted(len(ids), share, k))] = True
        return found_table(list(best_of(values[asked], ids[asked], probed, values, units, ids, cells, k)))

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, halves: int = 32, share: float = 0.55,
            sample: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found to each row of ``vectors`` (vec_id, embedding)
    whose vec_id is divisible by ``every``, against all rows but its own.

    Centroids (``halves`` for each half) are fitted on the ``sample`` rows with the smallest hash; every row is
    indexed. A query visits cells until they hold ``share`` of all rows, at least 100 k: vectors without clusters
    need about half for a recall of 0.9, clustered ones far less; with share 1 the result is exact. The score is the
    cosine in double precision on the vectors as given; ties go to the smaller vec_id.

    No part is taken by vectors that are null, empty, all zero or hold a null, NaN or infinite component, and by rows
    without vec_id. Vectors of one length are compared among themselves: each length has an index of its own, the
    commonest and every other that more than SMALL rows have one after the other, all the rest in one job with a task
    for each. A vec_id with several vectors asks with each of them and is found by each; its best score counts. Of
    equal vectors only the k + 1 smallest vec_ids are ranked, as no other can be among k; all of them are queries.
    Fewer candidates than k give fewer rows, an empty table none; other columns are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    typed = narrowed(vectors, vec_id="long", embedding="array<double>").where(
        "vec_id is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
        "exists(embedding, x -> x <> 0)").withColumn("hash", F.xxhash64("embedding"))
    typed = scratch.write(typed.groupBy("vec_id", "hash").agg(F.first("embedding").alias("embedding")).withColumn(
        "n", F.size("embedding")), "typed")
    sizes = typed.groupBy("n").count().orderBy(F.desc("count"), "n")
    commonest = sizes.first()
    if commonest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    large = [commonest["n"]] + [r["n"] for r in sizes.where(
        (F.col("count") > SMALL) & (F.col("n") != commonest["n"])).collect()]
    found = typed.where(~F.col("n").isin(large)).groupBy("n").applyInArrow(
        searched_whole(every, k, halves, share, sample), FOUND)
    for n in large:
        found = found.unionByName(searched(typed.where(F.col("n") == n), n, scratch, every, k, halves, share, sample))
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.selectExpr(
        "query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank",
        "vec_id", "score").where(F.col("rank") <= k)


def searched(typed: DataFrame, n: int, scratch: Scratch, every: int, k: int, halves: int, share: float,
             sample: int) -> DataFrame:
    """query_id, vec_id, score of the best of each block of the index over ``typed``, vectors of length ``n``."""
    spark = typed.sparkSession
    picked = typed.orderBy("hash", "vec_id").limit(sample).select("embedding").toArrow()
    index = fitted(unit_rows(picked["embedding"].combine_chunks())[1], halves)
    # of equal vectors those that can be among the nearest
    first = typed.selectExpr("vec_id", "embedding", "row_number() over (partition by hash order by vec_id) as copy")

    def celled(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit_rows(batch.column(1))[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())],
                                                 ["vec_id", "embedding", "cell"])

    rows = scratch.write(
        first.where(F.col("copy") <= k + 1).select("vec_id", "embedding").mapInArrow(
            celled, "vec_id long, embedding array<double>, cell int"), f"rows{n}")
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for row in rows.groupBy("cell").count().collect():  # as many rows as there are cells at most
        counts[row["cell"]] = row["count"]
    enough = wanted(counts.sum(), share, k)
    # cells in turn fill blocks of ROWS; a cell that holds more is spread over several
    ends = np.cumsum(counts)
    first_block = (ends - counts) // ROWS
    last_block = np.maximum(first_block, (ends - 1) // ROWS)
    chosen = typed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    chunks = max(1, -(-chosen.count() // QUERIES))

    def routed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = index.distances(unit_rows(batch.column(1))[1])
            at, blocks, lists = [], [], []
            for q in range(batch.num_rows):
                by_block: dict[int, list[int]] = {}
                for cell in visited(near[0][q], near[1][q], counts, enough):
                    for block in range(first_block[cell], last_block[cell] + 1):
                        by_block.setdefault(block, []).append(cell)
                for block, cells in by_block.items():
                    at.append(q)
                    blocks.append(block)
                    lists.append(cells)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(blocks, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                ["vec_id", "embedding", "block", "cells"])

    asked = chosen.mapInArrow(routed, "vec_id long, embedding array<double>, block int, cells array<int>").withColumn(
        "chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    spread = spark.createDataFrame(
        [(c, int(first_block[c]), int(last_block[c] - first_block[c] + 1)) for c in np.flatnonzero(counts).tolist()],
        "cell int, first_block int, blocks int")
    placed = rows.join(F.broadcast(spread), "cell").select(
        "vec_id", "embedding", "cell",
        (F.col("first_block") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def ranked(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            here, cells = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            probed = np.zeros((asked.num_rows, len(here)), bool)
            for q, visits in enumerate(asked["cells"].to_pylist()):
                probed[q] = np.isin(here, visits)
            values, units = unit_rows(rows["embedding"].combine_chunks())
            own = unit_rows(asked["embedding"].combine_chunks())[0]
            found = list(best_of(own, asked["vec_id"].to_numpy(), probed, values, units, rows["vec_id"].to_numpy(),
                                 cells, k))
        return found_table(found)

    return asked.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk")).applyInArrow(ranked, FOUND)


def op9_multi_index(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
