"""Token ids in flat binary files with 64-bit document offsets, read back through memory maps.

Documents are dealt by ranges of doc_id, and each task writes three files: ``.ids``
(flat unsigned integers, 16 bits where the vocabulary allows), ``.offsets`` (64-bit
end of each document, in ids of its own file) and ``.docs`` (64-bit doc_ids). Tasks
know nothing of each other: the place of a file's first id in the whole corpus, its
base, is the prefix sum of the id counts of the files before it. Names carry the
attempt, so that a repeated or speculative task never writes into another's file;
the manifest names the files that count.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, in_slices, stored, texts_of
from riskloom.llm.encoding import encoder
from riskloom.session import scratch_path

MANIFEST = "part long, file string, n_docs long, n_tokens long, width long"
_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files; the manifest: MANIFEST plus base.

    Documents stand in ascending doc_id order over all files (null ids first, equal
    ids by a hash of the text, repeated rows each on their own). Null texts count as
    empty and leave the end id alone. Columns other than doc_id and text are ignored;
    no document makes no file.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ordered = plain.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        name = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        files, docs_seen, total = None, 0, 0
        for batch in in_slices(batches):
            if not batch.num_rows:
                continue
            if files is None:
                store, path = fs.FileSystem.from_uri(name if "://" in name or name.startswith("file:") else f"file://{name}")
                store.create_dir(os.path.dirname(path), recursive=True)
                files = [store.open_output_stream(f"{path}.{kind}") for kind in ("ids", "offsets", "docs")]
            encoded = [coder.encode(text) for text in texts_of(batch.column(2))]
            ends = total + np.cumsum([len(x) // coder.dtype.itemsize + 1 for x in encoded], dtype="<i8")
            for ids in encoded:
                files[0].write(ids + end)
            files[1].write(ends.tobytes())
            files[2].write(np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], "<i8").tobytes())
            docs_seen, total = docs_seen + batch.num_rows, int(ends[-1])
        if files:
            for file in files:
                file.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [docs_seen], "n_tokens": [total], "width": [coder.dtype.itemsize]}, schema=_MANIFEST)

    manifest = stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, straight from their memory maps.

    ``start`` counts the ids of all documents before it; the checksum is taken of the
    ids as little-endian unsigned 32-bit integers. A null doc_id is stored as -1.
    """
    files = manifest.repartitionByRange(max(1, manifest.count()), "part")

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                name = row["file"]
                store, path = fs.FileSystem.from_uri(name if "://" in name or name.startswith("file:") else f"file://{name}")
                ends, ids_of, ids = (_mapped(store, f"{path}.{kind}", kind_type) for kind, kind_type in (("offsets", "<i8"), ("docs", "<i8"), ("ids", f"<u{row['width']}")))
                assert len(ends) == row["n_docs"] and len(ids) == row["n_tokens"], f"{name} is not whole"
                starts = np.concatenate([[0], ends[:-1]]).astype("int64")
                for low in range(0, len(ends), 4096):
                    at = slice(low, low + 4096)
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                    columns = [ids_of[at], starts[at] + row["base"], ends[at] - starts[at], np.array(sums, "int64")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, "int64")) for x in columns], schema=_ROWS)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where the store is a local or shared disk, read otherwise."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)
