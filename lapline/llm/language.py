"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the character n-grams (lengths 1 to 4) that both have, whatever their number, over the
geometric mean of how many each has: a blended-spectrum presence kernel. N-grams are hashed to ``SLOTS`` slots. A
bounded sample of labelled rows is the training set and part of it the landmarks; one-versus-rest ridge regression
in the landmarks' space gives one weight per landmark and language. A batch of texts is scored by two products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lapline.llm.shared import forget, narrowed, sliced

SLOTS = 4096
LENGTHS = (1, 2, 3, 4)
#: Texts in one matrix product.
BATCH = 512
#: Characters taken at once from a long text.
STEP = 1 << 18
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """One byte per slot: whether an n-gram of the whole text falls in it; letters in lower case."""
    flags = np.zeros(SLOTS, np.uint8)
    text = f" {text.lower()} "
    for start in range(0, len(text), STEP):  # pieces overlap, so no n-gram is lost
        codes = np.frombuffer(text[start:start + STEP + max(LENGTHS)].encode("utf-32-le", "replace"), np.uint32)
        grams = codes * np.uint32(0x9E3779B1)
        for length in LENGTHS:
            if length > 1:
                if len(codes) < length:
                    break
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[length - 1:]
            flags[(grams * np.uint32(0xC2B2AE3D)) >> np.uint32(20)] = 1
    return flags


def kernel(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Kernel of the rows of two 0/1 matrices."""
    norms = np.sqrt(np.outer(one.sum(axis=1), other.sum(axis=1)))
    return (one @ other.T) / np.maximum(norms, 1)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x slots, 0 or 1
    weights: np.ndarray  # landmarks x languages

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return kernel(flags.astype(np.float32), self.landmarks) @ self.weights


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(labelled: DataFrame, per_language: int = 600, landmarks_per_language: int = 48, ridge: float = 1e-3) -> Model:
    """Fit on ``labelled`` (text, lang): at most ``per_language`` texts of each language, chosen by their hash.

    The rows are turned into slots on the executors; a bit per slot comes to the driver, which solves one system of
    the size of the landmarks. Rows without text, letter or language are left out; equal texts count once, before the limit.
    """
    labelled = narrowed(labelled, text="string", lang="string")
    hashed = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # hashes are spread evenly, so a share of their range four times as large as is needed holds the smallest ones
    # of a language, and only these rows are shuffled, however many a language has
    counts = hashed.select("lang", "h").distinct().groupBy("lang").count().collect()  # one row per class that the model learns
    if not counts:
        return Model([], np.zeros((1, SLOTS), np.float32), np.zeros((1, 0), np.float32))
    upto = F.create_map(*(F.lit(x) for lang, n in counts
                          for x in (lang, min(2**63 - 1, 2**64 * 4 * per_language // n - 2**63))))
    near = hashed.where(F.col("h") <= F.element_at(upto, F.col("lang"))).dropDuplicates(["lang", "h"])
    picked = near.selectExpr("text", "lang", "h", "row_number() over (partition by lang order by h) as r").where(
        F.col("r") <= per_language)

    def run(batches):
        forget()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            flags = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(flags, pa.binary()), batch.column(2)],
                                             ["lang", "flags", "h"])

    rows = picked.select("text", "lang", "h").mapInArrow(run, "lang string, flags binary, h long").collect()
    rows = sorted({(r.lang, r.h): bytes(r.flags) for r in rows if r.flags is not None}.items())
    languages = sorted({lang for (lang, _), _ in rows})
    if not rows:
        return Model([], np.zeros((1, SLOTS), np.float32), np.zeros((1, 0), np.float32))
    flags = np.stack([np.unpackbits(np.frombuffer(bits, np.uint8)) for _, bits in rows]).astype(np.float32)
    own = np.array([languages.index(lang) for (lang, _), _ in rows])
    marks = np.concatenate([np.flatnonzero(own == k)[:landmarks_per_language] for k in range(len(languages))])
    landmarks = flags[marks]
    among = kernel(landmarks, landmarks).astype(np.float64)
    toward = kernel(flags, landmarks).astype(np.float64)
    # each language counts the same however many rows it has
    share = 1.0 / np.bincount(own)[own]
    system = toward.T @ (toward * share[:, None]) + ridge * among + 1e-9 * np.eye(len(marks))
    weights = np.linalg.solve(system, toward.T @ (np.eye(len(languages))[own] * share[:, None]))
    return Model(languages, landmarks, weights.astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) with lang_pred and score (0 to 1), from the text alone.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned. Equal
    scores go to the first language by name. Whole texts are read. Columns of these names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")))
    place = docs.columns.index("text")

    def run(batches):
        forget()
        model = shared.value
        for batch in sliced(batches, place=place):
            texts = batch.column(place).to_pylist()
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
            for start in range(0, len(known), BATCH):
                part = known[start:start + BATCH]
                values = model.scores(np.stack([presence(texts[k]) for k in part]))
                best = values.argmax(axis=1)
                for k, which, value in zip(part, best.tolist(), values[np.arange(len(part)), best].tolist()):
                    pred[k], score[k] = model.languages[which], min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def held_out() -> Column:
    """Whether a row is kept from learning: CRC-32 of the doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the labelled rows that aren't held out."""
    typed = narrowed(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out())
    model = fit(typed.where("not held_out"))
    return predict(typed.select("doc_id", "held_out", "text"), model).drop("text")


def op7_string_kernel(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
