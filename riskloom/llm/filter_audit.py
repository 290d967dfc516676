"""How quality filters interact: what each step of each order of the filters removes.

Each document fails or passes each filter. Counted per part and combination, that is
one 2x2x...x2 tensor per part. Every figure of every step of every order is that
tensor contracted with one vector per axis: (1, 0) keeps what passes the filter,
(0, 1) what fails it, (1, 1) both. Only the counts, at most 2^k rows a part, meet in
one place; documents are never sorted or grouped whole.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, begin, in_slices, stored, texts_of

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
TEXT_FILTERS = "ABCD"
COPY_FILTER = "E"
_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
_SYMBOLS = b"#$%&*|"
_FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
_FIGURES = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: bytes) -> int:
    """Bits of the failed text filters: few words, few distinct ones, many capitals, symbols."""
    words = text.split()
    characters = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text.translate(None, _SYMBOLS)) < len(text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * characters, symbols)
    return sum(1 << bit for bit, fail in enumerate(fails) if fail)


def document_flags(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask of failed text filters, digest of the text), one row per row."""

    def flagged(batches: Batches) -> Batches:
        begin("filter_audit")
        for batch in in_slices(batches):
            masks, digests = [], []
            for raw in texts_of(batch.column(2), b""):
                masks.append(text_failures(raw))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], schema=_FLAGS)

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return plain.mapInArrow(flagged, "doc_id long, part string, mask int, digest binary")


def contingency(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per combination of failed filters A to E, as bits from A upwards.

    A row with the least doc_id of its text passes E, and so do all rows without an id,
    which are nobody's copy. Other rows of the same text find no partner in a join on
    text and id, so a text that a third of all rows share is no hot key. A document is
    good (toxic) when any of its label rows says 1.
    """
    flags = stored(document_flags(docs, part), "audit-flags")
    firsts = flags.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    label = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = flags.join(firsts, ["digest", "doc_id"], "left").join(label, "doc_id", "left")
    mask = F.col("mask") + copied.cast("int") * (1 << len(TEXT_FILTERS))
    return rows.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def step_selections(names: str) -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """All (order, step), the axis filtered there, and per figure one vector per axis: arrays of steps x axes x 2."""
    steps, own = [], []
    chosen: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique": []}
    for order in permutations(range(len(names))):
        for step, axis in enumerate(order):
            earlier = set(order[:step])
            steps.append(("".join(names[a] for a in order), step + 1))
            own.append(axis)
            for figure, before, at, others in (("kept", PASS, PASS, ALL), ("removed", PASS, FAIL, ALL), ("failing", ALL, FAIL, ALL), ("unique", PASS, FAIL, PASS)):
                chosen[figure].append([at if a == axis else before if a in earlier else others for a in range(len(names))])
    return steps, np.array(own), {figure: np.array(vectors, np.int64) for figure, vectors in chosen.items()}


def contract(tensors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Parts x measures x 2 x ... x 2 with one vector per step and axis, to parts x measures x steps."""
    axes = vectors.shape[1]
    letters = "abcdefghij"[:axes]
    terms = ",".join(f"s{letter}" for letter in letters)
    return np.einsum(f"pk{letters},{terms}->pks", tensors, *[vectors[:, a] for a in range(axes)], optimize="greedy")


def figures(tensors: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """Parts x steps, per figure, from the counts of all, of good and of toxic documents."""
    _, own, chosen = step_selections(names)
    lost, everything = contract(tensors, chosen["removed"]), tensors[:, :1]
    removed = lost[:, 0]
    shares = np.stack([removed[:, own == axis].sum(axis=1) for axis in range(len(names))], axis=1)
    return {
        "kept": contract(everything, chosen["kept"])[:, 0],
        "removed": removed,
        "redundant": contract(everything, chosen["failing"])[:, 0] - removed,
        "unique_fails": contract(everything, chosen["unique"])[:, 0],
        "good_lost": lost[:, 1],
        "toxic_lost": lost[:, 2],
        "shapley": shares[:, own],
    }


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """Per part, order and step the figures, from (part, mask, n, good, toxic). Every part has all orders and steps."""
    orders = step_selections(names)[0]

    def steps(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                some = batch.slice(start, 32)
                tensors = np.zeros((some.num_rows, 3, 1 << len(names)), np.int64)
                for at, cells in enumerate(some.column(1).to_pylist()):
                    for cell in cells:
                        tensors[at, :, cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                # Bit a of a mask is axis a, so the axes of the reshaped tensor come in reverse.
                tensors = tensors.reshape(some.num_rows, 3, *[2] * len(names)).transpose(0, 1, *range(len(names) + 1, 1, -1))
                parts = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(orders))))
                columns = [parts, pa.array([o for o, _ in orders] * some.num_rows), pa.array([s for _, s in orders] * some.num_rows, pa.int32())]
                found = figures(tensors, names)
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.ravel()) for x in found.values()]], names=["part", "filter_order", "step", *found])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(steps, f"part string, filter_order string, step int, {_FIGURES}")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Figures of filters A to E over ``docs``, per value of ``part``, order of the filters and step.

    Null texts are empty (they fail A alone, and E beside another empty text), a null
    ``part`` is the empty string, repeated rows count each, and a table without rows has
    no part. Other columns are ignored, whatever their names.
    """
    return interactions(contingency(docs, labels, part), TEXT_FILTERS + COPY_FILTER)
