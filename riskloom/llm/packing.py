"""Documents packed into training sequences: bounded-space online best-fit over many groups.

Only piece lengths travel. A document longer than a sequence is cut from its end into
full pieces, so that just its first piece can be shorter; full pieces are sequences of
their own. The short pieces are dealt over groups of bounded size by a hash, and each
group packs its stream into open bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, in_slices, stored, texts_of
from riskloom.llm.encoding import encoder

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class OpenBins:
    """At most ``most`` open bins; bit f of a bitset says whether one has f places free."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to capacity places: the fullest open bin that takes it, else a new one."""
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            room, number = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        number = self.free[room].pop()
        if not self.free[room]:
            self.bits &= ~(1 << room)
        self.open -= 1
        return number


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id behind them."""

    def cut(batches: Batches) -> Batches:
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype)
        for batch in in_slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, encoded in zip(batch.column(0).to_pylist(), map(coder.encode, texts_of(batch.column(1)))):
                ids = np.concatenate([np.frombuffer(encoded, coder.dtype), end]).astype("<u4")
                first = len(ids) % capacity
                borders = ([0] if first else []) + list(range(first, len(ids) + 1, capacity))
                for piece, (low, high) in enumerate(zip(borders, borders[1:])):
                    for column, value in zip(out, (doc_id, piece, low, high - low, zlib.crc32(ids[low:high].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES)], schema=_PIECES)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, open_bins: int = 32_768, per_group: int = 100_000) -> DataFrame:
    """Pieces of all documents with sequence_id and the offset in it, gapless from 0.

    A null text counts as empty: a piece with the end id alone. Repeated rows and
    null ids are packed like others; columns other than doc_id and text are ignored;
    no rows, no sequences. ``per_group`` bounds what one packing task holds and
    ``open_bins`` its open bins.
    """
    pieces = stored(document_pieces(docs, tokenizer, end_id, capacity), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // per_group))
    # Long pieces first: they open the bins that the shorter ones fill.
    dealt = short.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups)))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins = OpenBins(capacity, open_bins)
        places = np.array([bins.place(length) for length in rows["length"].tolist()], "int64").reshape(-1, 2)
        return rows.drop(columns="group").assign(sequence_id=-1 - ((int(key[0]) << 32) | places[:, 0]), offset=places[:, 1])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(packed, schema).unionByName(full)
