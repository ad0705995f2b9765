"""Language identification by nearest centroid.

A text becomes the TF-IDF vector of its hashed byte n-grams (1 to 3 bytes of the lower-cased text, all but letters folded to
single spaces), scaled to length one. Each language has several centroids, found by spherical k-means among its training
texts; a text gets the language of the centroid with the highest cosine. A text further from that centroid than nearly all of its
training members is rejected: the operator then says `und`, and keeps the nearest language beside it.

The classifier is fitted on a bounded sample: TRAIN_DOCS labelled texts per language (in expectation, by a hash of the
identifier), each language in a task of its own. Prediction reads every text whole and sees nothing but the text.

Defined results: a null text, or one without a letter, is `und` with score 0; without training rows every text is `und`; an empty
table gives an empty result; rows that repeat are predicted alike; ties go to the language first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, kept_on_disk, table

#: Training texts per language, in expectation.
TRAIN_DOCS = 600
CENTROIDS = 4
DIMS = 1 << 13
ROUNDS = 12
#: Share of a centroid's training members that its rejection distance lets through, and the slack on top.
INSIDE, SLACK = 0.995, 1.15
SEED = 42

_LETTER = regex.compile(r"\p{L}")
#: Bytes below 128 that are no letters become spaces.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    counts = np.zeros(DIMS, np.int64)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for at in range(0, len(data), 1 << 20):
        b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        code = b + np.uint32(1)
        counts += np.bincount((code[: 1 << 20] * np.uint32(2654435761)) >> shift, minlength=DIMS)
        for width in (1, 2):
            code = (code[:-1] << np.uint32(8)) + b[width:] + np.uint32(1)
            counts += np.bincount((code[: 1 << 20] * np.uint32(2654435761)) >> shift, minlength=DIMS)
    return counts


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    rows = np.empty((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        rows[i] = np.log1p(ngram_counts(text)) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts: unit centroids, and their rejection distances."""
    middle = rows.mean(axis=0)
    chosen = [int(np.argmax(rows @ middle))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen].copy()
    for _ in range(ROUNDS):
        of = np.argmax(rows @ centres.T, axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                centre = rows[of == j].mean(axis=0)
                centres[j] = centre / max(float(np.linalg.norm(centre)), 1e-12)
    similar = rows @ centres.T
    of, distance = np.argmax(similar, axis=1), 1 - similar.max(axis=1)
    reach = [float(np.quantile(distance[of == j], INSIDE)) * SLACK if (of == j).any() else 0.0 for j in range(len(centres))]
    return centres, np.array(reach)


class Model:
    def __init__(self, langs: list[str], centres: np.ndarray, reach: np.ndarray, idf: np.ndarray) -> None:
        self.langs, self.centres, self.reach, self.idf = langs, centres, reach, idf

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(nearest language, cosine, rejected) of each text."""
        if not self.langs or not texts:
            return [("und", 0.0, True)] * len(texts)
        similar = vectors(texts, self.idf) @ self.centres.T
        best = np.argmax(similar, axis=1)
        top = np.clip(similar[np.arange(len(texts)), best].astype(float), 0.0, 1.0)
        return [(self.langs[j], s, 1 - s > self.reach[j]) for j, s in zip(best.tolist(), top.tolist(), strict=True)]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes  # else the texts are dealt by language
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(train_docs)) / F.col("n")
    sample = kept_on_disk(rows.join(sizes, "lang").where(part).select("lang", "text"))

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += ngram_counts(text.as_py()) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(seen, n))], names=["dim", "docs"])

    found = sample.mapInArrow(document_frequencies, "dim long, docs long").groupBy("dim").agg(F.sum("docs").alias("docs")).collect()  # DIMS + 1 rows
    counts = {r["dim"]: r["docs"] for r in found}
    total = counts.pop(-1, 0)
    seen = np.array([counts.get(d, 0) for d in range(DIMS)], float)
    idf = (np.log((1 + total) / (1 + seen)) + 0.1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, reach = cluster(vectors(sorted(pdf["text"]), idf), CENTROIDS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres], "reach": reach})

    fitted = sample.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, reach double").collect()  # CENTROIDS rows per language
    fitted = sorted(fitted, key=lambda r: (r["lang"], bytes(r["centre"])))
    sample.unpersist()
    centres = np.array([np.frombuffer(r["centre"], "<f4") for r in fitted], np.float32).reshape(-1, DIMS)
    return Model([r["lang"] for r in fitted], centres, np.array([r["reach"] for r in fitted]), idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (`und` if rejected), nearest (the nearest language), score (cosine), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in part.column("text")]
                lettered = [bool(_LETTER.search(t)) for t in texts]
                found = iter(own.predict([t for t, ok in zip(texts, lettered, strict=True) if ok]))
                rows = [next(found) if ok else ("und", 0.0, True) for ok in lettered]
                lang = ["und" if r[2] else r[0] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows])], names=["doc_id", "lang", "nearest", "score", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang string, nearest string, score double, rejected boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
