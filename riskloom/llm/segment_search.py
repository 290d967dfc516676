"""Exact top-k inner products with bounds from multi-resolution segment statistics.

With a vector's segments known by mean and deviation, the distance to another vector
is at least the sum over segments of length * ((difference of means)^2 + (difference
of deviations)^2); with the norms fixed this bounds the inner product from above by
the sum of length * (product of means + product of deviations). Bounds go from few
segments to many, and inner products are computed where every bound reaches the k-th
best score so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, stored

_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_EXACT = 1 << 53
_LONGEST = 1 << 63


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that a plain product of two rows is the bound."""
    edges = np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int)
    lengths = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / lengths
    squares = np.add.reduceat(rows**2, edges[:-1], axis=1) / lengths
    deviations = np.sqrt(np.maximum(squares - means**2, 0))
    weights = np.sqrt(lengths)
    return np.concatenate([means * weights, deviations * weights], axis=1)


class Best:
    """The k best (score, vec_id) of each query so far; ties go to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, levels: tuple[int, ...]):
        self.ids, self.rows, self.k, self.levels = ids, rows, k, levels
        self.stats = [statistics(rows, n) for n in levels]
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.largest = float(np.abs(rows).max(initial=0))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        if rows.shape[1] * self.largest * float(np.abs(rows).max(initial=0)) >= _EXACT:
            self._add_exact(ids, rows)
            return
        open_pairs = self.ids[:, None] != ids[None, :]
        columns = np.arange(len(ids))
        for own, n in zip(self.stats, self.levels):
            bound = own @ statistics(rows[columns], n).T
            bound += 1e-9 * np.abs(bound) + 1e-3
            open_pairs &= bound >= self.least[:, None]
            left = open_pairs.any(axis=0)
            open_pairs, columns = open_pairs[:, left], columns[left]
        queries = np.flatnonzero(open_pairs.any(axis=1))
        if not len(queries):
            return
        scores = np.where(open_pairs[queries], self.rows[queries] @ rows[columns].T, -np.inf)
        for q, row in zip(queries.tolist(), scores):
            if len(row) > self.k:
                least = max(self.least[q], np.partition(row, -self.k)[-self.k])
                at = np.flatnonzero((row >= least) & (row > -np.inf))
            else:
                at = np.flatnonzero(row > -np.inf)
            self._merge(q, zip(row[at].astype("int64").tolist(), ids[columns[at]].tolist()))

    def _add_exact(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """With integers of any size, for components so large that doubles could round."""
        whole = [[int(x) for x in row] for row in rows]
        for q, own in enumerate(self.rows):
            own = [int(x) for x in own]
            scores = [min(max(sum(a * b for a, b in zip(own, row)), -_LONGEST), _LONGEST - 1) for row in whole]
            self._merge(q, [(s, i) for s, i in zip(scores, ids.tolist()) if i != self.ids[q]])

    def _merge(self, q: int, more) -> None:
        best = sorted([*self.found[q], *more], key=lambda x: (-x[0], x[1]))[: self.k]
        self.found[q] = best
        if len(best) == self.k:
            self.least[q] = best[-1][0]

    def batch(self) -> pa.RecordBatch:
        flat = [(int(q), i, s) for q, best in zip(self.ids, self.found) for s, i in best]
        columns = list(zip(*flat)) if flat else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_BEST)


def top_inner_products(vectors: DataFrame, is_query: F.Column, k: int = 5, levels: tuple[int, ...] = (4, 16), queries_per_block: int = 4096, rows_per_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` other rows with the greatest inner products of floor(256 * x).

    Vectors that are null or empty or hold null or non-finite components take no part,
    nor do null ids; vectors of different lengths do not meet; of rows with one vec_id
    the least vector counts. Scores are exact; one that would leave the range of long
    becomes its nearest end. Rows and queries travel packed in blocks, every block of rows
    meets every block of queries in one of many groups, and a task holds a block of
    each and k results per query.
    """
    value = F.col("embedding").cast("array<double>")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).filter(F.col("vec_id").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = plain.filter(finite & (F.size("embedding") > 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # From 2 ** 52 on a double is whole already, and floor() would end at the range of long.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x * 256) < 2.0**52, F.floor(x * 256).cast("double")).otherwise(x * 256))
    usable = usable.select("vec_id", F.size("embedding").alias("dim"), whole.alias("row"))
    usable = stored(usable, "segment-rows")

    def packed(rows: DataFrame, per_block: int, name: str) -> DataFrame:
        sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))
        dealt = rows.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

        def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            ids, matrix = group["vec_id"].to_numpy("<i8"), np.stack(group["row"].to_list()).astype("<f8")
            return pd.DataFrame({"dim": [key[0]], name: [key[1]], "blocks": [int(group["blocks"].iloc[0])], f"{name}_ids": [ids.tobytes()], f"{name}_rows": [matrix.tobytes()]})

        out = dealt.groupBy("dim", "block").applyInPandas(pack, f"dim int, {name} int, blocks int, {name}_ids binary, {name}_rows binary")
        return stored(out, f"segment-{name}")

    asked = packed(usable.filter(is_query), queries_per_block, "query").withColumnRenamed("blocks", "query_blocks")
    held = packed(usable, rows_per_block, "held").withColumnRenamed("blocks", "held_blocks")
    # Each block of rows goes to every block of queries; a group has at most four blocks of rows.
    query_blocks = asked.select("dim", "query_blocks").distinct()
    held = held.join(query_blocks, "dim").withColumn("query", F.explode(F.expr("sequence(0, query_blocks - 1)")))
    held = held.withColumn("part", F.expr("held div 4").cast("int")).select("dim", "query", "part", "held_ids", "held_rows")
    held_blocks = usable.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("held_blocks"))
    asked = asked.join(held_blocks, "dim").withColumn("part", F.explode(F.expr("sequence(0, cast((held_blocks - 1) div 4 as int))")))
    pairs = held.join(asked.select("dim", "query", "part", "query_ids", "query_rows"), ["dim", "query", "part"])
    pairs = pairs.sortWithinPartitions("dim", "query", "part")

    def searched(batches: Batches) -> Batches:
        at, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["dim"], row["query"], row["part"]):
                    if best:
                        yield best.batch()
                    at = (row["dim"], row["query"], row["part"])
                    best = Best(np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["query_rows"], "<f8").reshape(-1, row["dim"]), k, levels)
                best.add(np.frombuffer(row["held_ids"], "<i8"), np.frombuffer(row["held_rows"], "<f8").reshape(-1, row["dim"]))
        if best:
            yield best.batch()

    found = pairs.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
