"""What tasks leave in a worker process, and how many wide rows come to Python at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from lapline.llm import bpe, jaccard, search, shared


def test_tables_of_other_operators_are_let_go():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = bpe.word_encoder(path)
    assert bpe.word_encoder(path) is first
    shared.forget()
    assert bpe.word_encoder.cache_info().currsize == 0


def test_rows_of_a_slice_by_a_text_anywhere():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 30, "z"]), pa.array([1, 2, 3, 4])], ["text", "id"])
    cut = list(shared.sliced([batch], rows=2, size=25, place=0))
    assert [part.column(1).to_pylist() for part in cut] == [[1, 2], [3], [4]]


def test_linked_sets_come_in_small_batches(spark, table, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, linked = spark.conf.get(name), jaccard.linked

    def noted(*args):
        seen.append(int(spark.conf.get(name)))
        return linked(*args)

    monkeypatch.setattr(jaccard, "linked", noted)
    rows = [(1, "a b c d e f"), (2, "a b c d e f g"), (3, "h i j")]
    assert jaccard.near_duplicates(table(rows), 1, 80, 100).count() == 3
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before


def test_a_shard_is_made_in_few_bytes_a_posting():
    lists, each = 4_000, 100
    bounds = np.arange(lists + 1) * each
    docs = np.tile(np.arange(each, dtype=np.int32) * 40, lists)
    docs[1::each] = docs[::each]  # a doc_id that comes twice
    weights = np.random.default_rng(1).random(len(docs))
    tracemalloc.start()
    shard = search.Shard(np.arange(4_000), bounds, docs, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shard.docs) == lists * (each - 1) and peak < 50 * len(docs)
