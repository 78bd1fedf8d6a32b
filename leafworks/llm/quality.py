"""Quality classifier: naive Bayes support vectors over n-grams of word shapes.

A text is the sequence of its words' shapes (case, kind of first and last character, length class, and
whether the word repeats the one before), so that it works for words never seen. Features are the
indicators of shape n-grams up to ``GRAMS``, hashed. Indicators are scaled by the classes' log-count
ratio, and a linear hinge-loss model is fitted to those by dual coordinate descent.
Fitting takes the ``SAMPLE`` labelled rows with the smallest hashes; scoring reads every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import CHUNK_BYTES, slices, text_bytes

#: Labelled rows that the model is fitted to, at most.
SAMPLE = 6000
GRAMS, BITS = 3, 18
THRESHOLD = 0.3


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = x = zlib.crc32(shape(word)) & 0x3FF
        return x


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def shape(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace")
    letters = [c for c in text if c.isalpha()]
    case = "-" if not letters else "U" if all(c.isupper() for c in letters) and len(letters) > 1 else "l" if all(not c.isupper() for c in letters) else "T" if text[0].isupper() and not any(c.isupper() for c in letters[1:]) else "m"
    others = sum(not c.isalnum() for c in text)
    return f"{case}{_kind(text[0])}{_kind(text[-1])}{min(others, 3)}{min(len(text), 24).bit_length()}".encode()


def features(text: bytes, shapes: dict) -> np.ndarray:
    """Distinct hashed shape n-grams of a text."""
    words = text.split()
    if not words:
        return np.zeros(1, np.int64)  # the empty text has a feature of its own
    codes = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    again = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)
    codes[1:] |= again.astype(np.int64) << 10
    codes += 1
    out, gram = [], np.zeros(len(codes), np.int64)
    for n in range(GRAMS):
        if len(codes) <= n:
            break
        gram = gram[: len(codes) - n] * 2053 + codes[n:]
        out.append((((gram + n) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BITS))
    return np.unique(np.concatenate(out))


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, c: float = 1.0, epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift): log-count ratios, dual coordinate descent, Platt scaling."""
    dim = 1 << BITS
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return np.zeros(dim), 0.0, 0.0, math.log(share / (1 - share))
    p, q = np.full(dim, alpha), np.full(dim, alpha)
    for x, t in zip(rows, y):
        (p if t > 0 else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[x] / math.sqrt(len(x)) for x in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, dual, rng = np.zeros(dim), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    cost = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), cost[i])
            if (step := (new - dual[i]) * y[i]) != 0:
                w[x] += step * v
                bias += step
                worst = max(worst, abs(step))
                dual[i] = new
        if worst < 1e-3:
            break
    margins = np.array([w[x] @ v for x, v in zip(rows, values)]) + bias
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, damped
        s = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = s - goal, np.maximum(s * (1 - s), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * margins).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        a, b = a - 0.7 * da, b - 0.7 * db
    return w * ratio, bias, a, b


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """Fit to labelled rows that aren't held out; labels other than 0 and 1 count as none, and so do those of
    an id that is labelled both. Of documents that share an id the one with the smallest features is learned."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most")
    chosen = agreed.select("doc_id", "quality").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)
    wanted = {r.doc_id: r.quality for r in chosen.collect()}  # sample rows at most
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in wanted], "wanted long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in slices(batches, "text", CHUNK_BYTES):
            found = [features(x, shapes).astype(np.int32).tobytes() for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(keys, F.col("doc_id") == F.col("wanted"), "left_semi").mapInArrow(run, "doc_id bigint, grams binary")
    found = sorted((r.doc_id, bytes(r.grams)) for r in rows.groupBy("doc_id").agg(F.min("grams").alias("grams")).collect())
    return fit([np.frombuffer(g, np.int32).astype(np.int64) for _, g in found], np.array([wanted[d] for d, _ in found]))


def score(docs: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) and ``score`` of every row: the model's probability of label 1."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        w, bias, slope, shift = shared.value
        for batch in slices(batches, "_text", 2 * CHUNK_BYTES):
            found = (features(x, shapes) for x in text_bytes(batch.column("_text")))
            margins = np.fromiter((w[x].sum() / math.sqrt(len(x)) + bias for x in found), float, batch.num_rows)
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores)], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id), held_out, score and predicted of every row of ``docs(doc_id, text)``.

    Without labels of both classes every score is the (smoothed) share of label 1. Null and blank texts
    share one score; a row without an id counts as held out (its text is empty, and nothing is
    learned from it); repeated rows are scored alike; an empty table
    gives an empty table; lang, source and ids are not inputs of a score.
    """
    scored = score(docs, train(docs, labels), keep)
    id_ = F.col("doc_id")
    return scored.withColumns({"held_out": held_out(id_, 5, 0), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
