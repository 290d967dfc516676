"""Quality scores by naive Bayes support vectors.

An n-gram's weight starts from its log-count ratio between the classes, counted over
all labelled rows. A linear hinge-loss model over indicators scaled by these ratios is
fitted by dual coordinate descent on a bounded sample of them, and its margins turn
into scores by a logistic curve fitted on labelled rows that the model has not seen.
N-grams are those of words, and of the shapes of words (letter case, digits, marks
around them, whether a word repeats the one before).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, begin, held, in_slices, mix, stored, texts_of

BUCKETS = 1 << 18  # hashed n-grams; bounds everything that is learnt
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[^\W\dA-Z_]+", "a"), (r"[0-9]+", "0"))]
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_shape(word: str) -> str:
    for pattern, letter in _SHAPES:
        word = pattern.sub(letter, word)
    return word


class WordCodes(dict):
    """Two 32-bit hashes of each word in one integer: of its lower-cased letters above, of its shape below."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        code = self[word] = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(word_shape(word))
        return code


_CODES = held("quality", WordCodes())
_LAST_SEEN = np.zeros(BUCKETS, np.int64)


def indicators(text: str) -> np.ndarray:
    """The distinct buckets of the n-grams of a text, none for a text without words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    letters, shapes = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(codes), np.uint64)
    again[1:] = letters[1:] == letters[:-1]
    shapes = shapes * np.uint64(2) + again
    grams = [letters * _P1, shapes * _P2]
    if len(codes) > 1:
        grams += [mix(letters[:-1] * _P1 + letters[1:]), mix(shapes[:-1] * _P2 + shapes[1:])]
    if len(codes) > 2:
        grams.append(mix(shapes[:-2] * _P3 + mix(shapes[1:-1] * _P2 + shapes[2:])))
    buckets = (mix(np.concatenate(grams)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    places = np.arange(len(buckets))
    _LAST_SEEN[buckets] = places  # the last place of each bucket stands for it
    return buckets[_LAST_SEEN[buckets] == places]


def log_count_ratios(good: np.ndarray, bad: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of an n-gram's share among good rows over that among bad rows; zero where it occurs in neither."""
    p, q = good + smoothing, bad + smoothing
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(good + bad > 0, ratios, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, passes: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over indicators scaled by ``ratios``, each row of unit length.

    The classes weigh the same in sum, whatever their sizes.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    scale = [1 / max(1e-9, np.sqrt((ratios[row] ** 2).sum() + 1)) for row in rows]
    share = {y: len(labels) / (2 * max(1, (labels == y).sum())) for y in (-1, 1)}
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, y = rows[i], labels[i]
            margin = scale[i] * (weights[row] @ ratios[row] + bias)
            new = min(max(alpha[i] + (1 - y * margin), 0.0), cost * share[int(y)])  # rows have unit length
            step = (new - alpha[i]) * y * scale[i]
            if step:
                weights[row] += step * ratios[row]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from margins to the chance of label 1, by Newton steps with a mild prior."""
    target = (labels > 0).astype(float)
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-2 * (beta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that never serve for learning: the checksum of the id as text leaves 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, good) of the documents to learn from; of an id labelled twice the lower quality counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    known = known.filter(F.col("good").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("good").alias("good"))
    # One plan at every size: labels grow with the documents, so they are never broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known.hint("merge"), "doc_id")


def gram_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket, in how many good and bad rows it occurs; all rows are counted, BUCKETS sums come back."""

    def count(batches: Batches) -> Batches:
        begin("quality")
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in in_slices(batches):
            for text, good in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                sums[0 if good else 1][indicators(text)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        for start in range(0, len(at), 65_536):
            part = at[start : start + 65_536]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part), "good": pa.array(sums[0][part]), "bad": pa.array(sums[1][part])})

    counted = labelled.select("doc_id", "text", "good").mapInArrow(count, "bucket long, good long, bad long")
    sums = counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[sums.bucket], bad[sums.bucket] = sums.good, sums.bad
    return good, bad


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, cost: float = 1.0) -> dict:
    """A model learnt from the labelled rows that are not held out.

    Counts cover all of them. Weights are fitted on at most ``sample_rows`` rows, the
    first by a hash of their ids, a fifth of which only serves for the logistic curve.
    Where one class has no row there is nothing to learn: the model then gives every
    text 0 if all rows are bad, else 1.
    """
    labelled = _labelled(docs, labels)
    good, bad = gram_counts(labelled)
    chosen = labels.filter(F.col("quality").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = _labelled(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), labels)  # sample_rows ids at most

    def featured(batches: Batches) -> Batches:
        begin("quality")
        for batch in in_slices(batches):
            rows = [indicators(text).astype("<i4").tobytes() for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "good", "grams"])

    rows = sample.mapInArrow(featured, "doc_id long, good boolean, grams binary").toPandas().sort_values(["doc_id", "grams"])
    if not rows.good.any() or rows.good.all():
        return {"constant": 0.0 if len(rows) and not rows.good.any() else 1.0}
    grams = [np.frombuffer(x, "<i4") for x in rows.grams]
    signs = np.where(rows.good, 1, -1)
    ratios = log_count_ratios(good, bad)
    for_curve = np.arange(len(rows)) % 5 == 4
    if len(set(signs[for_curve])) < 2 or len(set(signs[~for_curve])) < 2:
        for_curve = np.zeros(len(rows), bool)
    train = np.flatnonzero(~for_curve)
    weights, bias = dual_coordinate_descent([grams[i] for i in train], signs[train], ratios, cost)
    model = {"weights": (weights * ratios).astype(np.float32), "squares": (ratios**2).astype(np.float32), "bias": bias}
    seen = np.flatnonzero(for_curve) if for_curve.any() else train
    slope, shift = logistic_curve(np.array([margin(model, grams[i]) for i in seen]), signs[seen])
    return model | {"slope": slope, "shift": shift}


def margin(model: dict, grams: np.ndarray) -> float:
    return float((model["weights"][grams].sum(dtype=float) + model["bias"]) / np.sqrt(model["squares"][grams].sum(dtype=float) + 1))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column score, 0 to 1, higher where quality 1 is likelier.

    Every row gets one, null and empty texts that of the bias alone. A column of
    ``docs`` that is named score is replaced.
    """
    kept = docs.drop("score")
    at = kept.columns.index("text")
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def scored(batches: Batches) -> Batches:
        begin("quality")
        for batch in in_slices(batches):
            if "constant" in model:
                scores = [model["constant"]] * batch.num_rows
            else:
                scores = [1 / (1 + np.exp(-np.clip(model["slope"] * margin(model, indicators(text)) + model["shift"], -500, 500))) for text in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(scored, schema)
