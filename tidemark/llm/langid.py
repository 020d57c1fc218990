"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the normalised count of byte n-grams (1 to 4, hashed)
present in both.  A bounded, stratified sample of labelled documents is fitted by
one-versus-rest kernel ridge regression on Nystroem landmarks.  Scoring is one
matrix product a batch: presence vectors times landmarks, times the coefficients.
Whole texts count; a text is read in one pass, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import cut, held_out

GRAMS = (1, 2, 3, 4)
DIM = 1 << 13
SAMPLE_A_LANGUAGE = 300  # labelled documents of each language that the fit uses, about
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
BATCH = 256


def presence(column: pa.Array) -> np.ndarray:
    """One row of 0/1 for each text: which hashed n-grams of the lower-cased bytes it has."""
    out = np.zeros((len(column), DIM), dtype=np.float32)
    for at, part in tk.slices(column, 1 << 20):
        data, offsets = tk.raw(part)
        low = data.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        low[(low < 97) & (low != 39)] = 32  # digits, punctuation and spaces are one symbol
        doc = np.repeat(np.arange(len(part)), np.diff(offsets)) + at
        h = np.zeros(len(low), dtype=np.uint32)
        code = low.astype(np.uint32) + np.uint32(1)
        for n in range(1, max(GRAMS) + 1):
            # h[i]: hash of the n bytes from i on
            h = h[: len(low) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] if n > 1 else code.copy()
            if n in GRAMS:
                inside = doc[: len(h)] == doc[n - 1 :]
                slot = ((h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13)
                out[doc[: len(h)][inside], slot[inside]] = 1.0
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1.0))
    return (rows @ landmarks.T) / size


def fit(texts: pa.Array, langs: list[str]) -> dict:
    """landmarks (scaled presence vectors), coefficients (landmarks x languages), languages."""
    names = sorted(set(langs))
    rows = np.concatenate([presence(texts.slice(i, BATCH)) for i in range(0, len(texts), BATCH)]) if len(texts) else np.zeros((0, DIM), np.float32)
    # Landmarks alternate between languages, so that each has its share.
    turn = {}
    order = sorted(range(len(langs)), key=lambda i: (turn.setdefault(langs[i], []).append(i), len(turn[langs[i]]), langs[i])[1:])
    chosen = order[:LANDMARKS]
    scale = np.sqrt(np.maximum(rows[chosen].sum(axis=1, keepdims=True), 1.0))
    landmarks = rows[chosen] / scale
    c = kernel(rows, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel(rows[chosen], landmarks).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = c @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([langs.count(x) for x in langs], dtype=np.float64)[:, None]  # languages weigh alike
    weight *= len(langs) / len(names)
    beta = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return {"landmarks": landmarks.astype(np.float32), "coefficients": (root @ beta).astype(np.float32), "names": names}


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    margins = kernel(presence(column), model["landmarks"]) @ model["coefficients"]
    best = margins.argmax(axis=1)
    p = np.exp(4.0 * (margins - margins.max(axis=1, keepdims=True)))
    return [model["names"][i] for i in best], (p.max(axis=1) / p.sum(axis=1)).astype(np.float64)


def sample(docs: DataFrame) -> DataFrame:
    """Rows of documents with text and language outside the held-out fold, about SAMPLE_A_LANGUAGE of each language, chosen by the id's hash."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(held_out("doc_id", 4) != 2)
    share = rows.groupBy("lang").agg((F.lit(float(SAMPLE_A_LANGUAGE)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) / 1_000_000
    # The ids are drawn without the texts, so no text is shuffled for a language's sake.
    ids = cut(rows.select("doc_id", "lang").join(share, "lang").where(draw < F.col("share")).select("doc_id", "lang"), "sample")
    return rows.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"], "left_semi")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of `docs`.

    A text that is null or has no letter is "und" with score 0; so is every text
    where no labelled document is there to learn from."""
    spark = docs.sparkSession
    learned = sample(docs).select("doc_id", F.col("text").cast("binary").alias("text"), "lang").toArrow().sort_by("doc_id")
    langs = learned["lang"].to_pylist()
    model = spark.sparkContext.broadcast(fit(learned["text"].combine_chunks(), langs) if langs else None)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lettered = np.array(part.column(2).to_pylist(), dtype=bool)
                names, score = predict(model.value, part.column(1)) if model.value else ([UNKNOWN] * part.num_rows, np.zeros(part.num_rows))
                names = [n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
