"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector shared by all thresholds, which are kept in order. The
output is the expected severity, the sum over k of P(grade > k); a document is toxic when P(grade > 0) reaches REJECT.

Fitting uses a bounded sample of labelled rows (TRAIN_DOCS, in expectation, by a hash of the identifier). Grades come from the
labels alone, never from the text: 0 is not toxic, 1 toxic, 2 toxic and of low quality, as the labels have no finer scale; without a
column for quality there are two grades. Features are the log counts of the VOCABULARY words and word stems most associated with the label, and whether any typical one occurs, where copies and near copies
(rows with the same SKETCH minimum hashes of word pairs) count once. Prediction reads every text whole.

Defined results: null and empty texts have no features and get the base rate's severity; null labels are ignored and of several
labels of a document the most severe counts; without both labels in the sample every severity is 0; an empty table
gives an empty result; rows that repeat are scored alike. Filtering passes all columns through untouched.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import frugal, id_and_text, kept_on_disk, table

TRAIN_DOCS = 6_000
VOCABULARY = 1_000
GRADES = 2
REJECT = 0.5
SEED = 42
#: A word must be typical by this chi-square value and occur in so many rows: a count, as a share of all rows would shut out small languages.
LEAST_CHI2, LEAST_ROWS = 40.0, 5
STEPS, RATE, L2 = 600, 0.1, 1e-4
#: Code of the feature that any typical feature occurs; typical ones occur in toxic rows to this share.
ANY, PURE = -1, 0.95
#: Hashes of word pairs that rows share to count once.
SKETCH = 4
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
#: Words that a task remembers.
MEMORY = 200_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: bytes | None) -> list[str]:
    return _WORDS((text or b"").decode("utf-8", "replace").lower())


def signature(words: list[str]) -> int:
    """Hash of the SKETCH smallest hashes of word pairs, which copies share and near copies mostly; other documents share one at times, hardly all."""
    if not words:
        return 0
    pairs = {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}
    least = heapq.nsmallest(SKETCH, (xxhash.xxh64_intdigest(p, SEED) for p in pairs))
    return xxhash.xxh64_intdigest(np.array(least, "<u8").tobytes(), SEED) >> 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the likelihood, by Adam on all rows."""
    n, v = x.shape
    share = np.array([np.clip((y <= k).mean(), 1e-3, 1 - 1e-3) for k in range(grades)])
    start = np.log(share / (1 - share))
    # thresholds as the first and the logs of the gaps, so they stay in order
    p = np.concatenate((np.zeros(v), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, s = np.zeros_like(p), np.zeros_like(p)
    high, low = np.minimum(y, grades - 1), np.maximum(y - 1, 0)
    for step in range(1, STEPS + 1):
        w, first, gaps = p[:v], p[v], np.exp(p[v + 1 :])
        t = first + np.concatenate(([0.0], np.cumsum(gaps)))
        z = x @ w
        upper = np.where(y < grades, sigmoid(t[high] - z), 1.0)
        lower = np.where(y > 0, sigmoid(t[low] - z), 0.0)
        inside = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(y < grades, upper * (1 - upper), 0.0) / inside, np.where(y > 0, lower * (1 - lower), 0.0) / inside
        gt = np.bincount(low, dl, grades) - np.bincount(high, du, grades)  # of the loss, by threshold
        gw = x.T @ (du - dl) / n + L2 * w
        tail = np.cumsum(gt[::-1])[::-1] / n
        g = np.concatenate((gw, tail[:1], tail[1:] * gaps))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:v], p[v] + np.concatenate(([0.0], np.cumsum(np.exp(p[v + 1 :]))))


def features_of(word: str) -> list[int]:
    """Hash codes of a word's features: itself, and its stems of 4 to 7 letters."""
    return [xxhash.xxh64_intdigest(f, SEED) >> 1 for f in (word, *(f"{word[:k]}-" for k in STEMS if len(word) > k))]


class Model:
    def __init__(self, weights: dict[int, float], thresholds: np.ndarray, typical: frozenset[int] = frozenset()) -> None:
        self.weights, self.thresholds, self.typical = weights, thresholds, typical
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: bytes | None) -> tuple[float, float, int]:
        """Expected severity, P(grade > 0), most likely grade."""
        if not len(self.thresholds):
            return 0.0, 0.0, 0
        hits: Counter = Counter()
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for word in words_of(text):
            codes = known.get(word)
            if codes is None:
                codes = known[word] = tuple(c for c in features_of(word) if c in self.weights)
            if codes:
                hits.update(codes)
        z = sum(np.log1p(c) * self.weights[code] for code, c in hits.items())
        if not self.typical.isdisjoint(hits):
            z += self.weights[ANY]
        above = 1 - sigmoid(self.thresholds - z)
        each = -np.diff(np.concatenate(([1.0], above, [0.0])))
        return float(above.sum()), float(above[0]), int(np.argmax(each))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality") -> Model:
    toxic = F.col(label_col).cast("int")
    worse = F.coalesce(F.col(quality_col).cast("int") == 0, F.lit(False)) if quality_col in labels.columns else F.lit(False)
    marks = labels.select(F.col(id_col).cast("long").alias("of"), F.when(toxic > 0, 1 + worse.cast("int")).when(toxic.isNotNull(), 0).alias("grade")).where("of is not null and grade is not null")
    marks = marks.groupBy("of").agg(F.max("grade").alias("grade"))
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("of", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30) < train_docs / max(1, n))
    # about train_docs rows of 12 bytes, whatever the size of the tables
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marks), F.col("doc_id") == F.col("of"))

    @frugal
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column("grade"), pa.array([signature(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([list(Counter(f).items()) for f in found], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["grade", "sig", "n", "words"])

    every = rows.select("grade", "text").mapInArrow(words, "grade int, sig long, n long, words map<string,long>")
    sample = kept_on_disk(every.groupBy("sig", "grade").agg(F.min_by("words", "n").alias("words")).coalesce(4))
    sizes = {r[0]: r[1] for r in sample.groupBy(F.col("grade") > 0).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        sample.unpersist()
        return Model({}, np.zeros(0))

    @frugal
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for grade, own in zip(batch.column("grade").to_pylist(), batch.column("words").to_pylist(), strict=True):
                seen[grade > 0].update({c for w, _ in own for c in features_of(w)})
        codes = list(seen[0].keys() | seen[1].keys())
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([seen[1][c] for c in codes], pa.float64()), pa.array([seen[0][c] for c in codes], pa.float64())], names=["code", "a", "b"])

    seen = sample.mapInArrow(counts, "code long, a double, b double").groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pos, neg = float(sizes[True]), float(sizes[False])
    a, b = F.col("a"), F.col("b")
    c, d, total = F.lit(pos) - a, F.lit(neg) - b, F.lit(pos + neg)
    chi2 = total * (a * d - b * c) * (a * d - b * c) / (F.greatest((a + b) * (c + d), F.lit(1.0)) * F.lit(pos * neg))
    best = seen.withColumn("chi2", chi2).where((F.col("chi2") >= LEAST_CHI2) & (a + b >= LEAST_ROWS))
    chosen = best.orderBy(F.desc("chi2"), "code").limit(VOCABULARY).select("code", "a", "b").collect()
    place = {r["code"]: i for i, r in enumerate(chosen)}
    typical = frozenset(r["code"] for r in chosen if r["a"] >= PURE * (r["a"] + r["b"]))

    @frugal
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for m in batch.column("words").to_pylist():
                hits: Counter = Counter()
                for w, k in m:
                    for code in features_of(w):
                        if code in place:
                            hits[code] += k
                own.append(list(hits.items()))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(own, pa.map_(pa.int64(), pa.int64()))], names=["grade", "x"])

    got = sample.select("grade", "words").mapInArrow(features, "grade int, x map<long,long>").collect()  # the bounded sample, VOCABULARY counts a row at most
    sample.unpersist()
    got = sorted(got, key=lambda r: (r["grade"], sorted(r["x"].items())))
    x = np.zeros((len(got), len(place) + 1))
    for i, r in enumerate(got):
        for code, k in r["x"].items():
            x[i, place[code]] = np.log1p(k)
        x[i, -1] = not typical.isdisjoint(r["x"])
    y = np.array([r["grade"] for r in got])
    w, t = fit_ordinal(x, y, GRADES)
    return Model(dict(zip([*place, ANY], w.tolist(), strict=True)), t, typical)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [own.score(t.as_py()) for t in batch.column("text")]
            p = [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), pa.array(p, pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([v >= REJECT for v in p])], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])
        own.known.clear()  # the worker keeps the model longer than the task

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, all columns as they came."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            keep = [own.score(t.encode() if isinstance(t, str) else t)[1] < REJECT for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))
        own.known.clear()

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))
