"""Benchmark passages in training text, found by suffix arrays of the training text.

Training documents are cut into shards of whole documents. A task builds the suffix
array over the words of a shard and looks up every suffix of the benchmark in it by
binary search: the range of equal windows tells all places, the neighbours of a suffix
its longest verbatim match. A shard knows nothing of other shards, so the training text
is neither shuffled nor gathered. The benchmark goes to the tasks in blocks of bounded
size; a larger benchmark makes more blocks, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, Codes, begin, in_slices, stored, texts_of

# A-Z become a-z, other ASCII but digits and letters separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20
SEGMENT_WORDS = 2_000
_FOUND = "doc_id long, digest string, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
_FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions of ``codes`` (not negative) in the order of their suffixes, by prefix doubling of what is still tied.

    A rank is the place of the first suffix of a tied group, so settled ranks never change.
    """
    count = len(codes)
    if count < 2:
        return np.arange(count)
    wide = codes.astype(np.int64)
    following = np.full(count, -1)
    following[:-1] = wide[1:]
    order = np.argsort(wide * (wide.max() + 2) + following + 1, kind="stable")
    keys = (wide * (wide.max() + 2) + following + 1)[order]
    rank = np.empty(count, np.int64)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[head, count])
    rank[order] = np.repeat(head, sizes)
    tied = np.repeat(sizes > 1, sizes)
    places = np.flatnonzero(tied)
    depth = 2
    while len(places):
        at = order[places]
        further = at + depth
        key = rank[at] * (count + 1) + np.where(further < count, rank[np.minimum(further, count - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[places] = at
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[head, len(key)])
        rank[at] = np.repeat(places[head], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


def insertion(codes: np.ndarray, order: np.ndarray, asked: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For each asked[start : start + length] the place in ``order`` before (or after) the suffixes that begin with it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        sign = compared(codes, order[middle], asked, starts[open_], lengths[open_])[1]
        right = sign < 0 if not after else sign <= 0
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)
    return low


def compared(codes: np.ndarray, at: np.ndarray, asked: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in common of suffixes ``at`` and asked sequences, and the sign of their first difference (0: a prefix)."""
    common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    going = np.flatnonzero(lengths > 0)
    while len(going):
        place = at[going] + common[going]
        inside = place < len(codes)
        own = np.where(inside, codes[np.minimum(place, len(codes) - 1)], -1)
        other = asked[starts[going] + common[going]]
        equal = own == other
        sign[going] = np.where(equal, 0, np.where(own < other, -1, 1))
        going = going[equal]
        common[going] += 1
        going = going[common[going] < lengths[going]]
    return common, sign


class Shard:
    """Whole documents as one sequence of word codes, each document closed by a code of its own, and its suffix array."""

    def __init__(self, known: Codes, documents: list[np.ndarray]) -> None:
        self.known, self.first = known, len(documents)  # smaller codes are the closing ones
        self.sizes = np.array([len(codes) for codes in documents], np.int64)
        self.starts = np.cumsum(np.r_[0, self.sizes + 1])[:-1]
        self.codes = np.concatenate([part for number, codes in enumerate(documents) for part in (codes + self.first, [number])])
        self.order = suffix_array(self.codes)

    def code(self, words: list[bytes]) -> np.ndarray:
        """Codes of asked words; -1 where the shard has no such word."""
        get, first = self.known.get, self.first
        return np.fromiter((get(word, -1 - first) + first for word in words), np.int64, len(words))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class Block:
    """Part of the benchmark: segments of items, and the windows that begin in them."""

    def __init__(self, segments: list[tuple[str, int, bytes]], window: int) -> None:
        texts = [text.split(b" ") for _, _, text in segments]
        sizes = np.array([len(words) for words in texts], np.int64)
        base = np.cumsum(np.r_[0, sizes])[:-1]
        self.words = [word for words in texts for word in words]
        per_item = np.maximum(sizes - window + 1, 1)
        self.items = [item for item, _, _ in segments]
        self.item = np.repeat(np.arange(len(segments)), per_item)
        self.starts = np.concatenate([b + np.arange(n) for b, n in zip(base, per_item)]) if segments else np.empty(0, np.int64)
        self.lengths = np.repeat(np.minimum(sizes, window), per_item)


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, int, bytes]]]:
    """The benchmark as lists of (item, first word, words), each of about ``block_bytes`` at most, one at a time.

    Items are cut into segments that overlap by a window less a word, so that every
    window lies in one segment and a long item is no block of its own.
    """

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[], [], []]
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1), b"")):
                words = words_of(text)
                step = SEGMENT_WORDS
                for start in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    out[0].append(item)
                    out[1].append(start)
                    out[2].append(b" ".join(words[start : start + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["item", "start", "words"])

    plain = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    segments = stored(plain.mapInArrow(cut, "item string, start long, words binary").distinct(), "benchmark-segments")
    size = segments.agg(F.coalesce(F.sum(F.length("words") + F.length("item") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes))  # twice as many as needed, as they are dealt by hash
    dealt = F.pmod(F.xxhash64("item", "start", "words"), F.lit(blocks))
    for block in range(blocks if size > block_bytes else 1):
        part = segments.filter(dealt == block) if size > block_bytes else segments
        yield [tuple(row) for row in part.collect()]


def shards_of(batches: Batches, shard_words: int) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Shards of ``shard_words`` words, or of one longer document, with the rows' columns but the last, which is the text."""
    known, documents, size = Codes(), [], 0
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        others, begun = batch.select(batch.schema.names[:-1]), 0
        for number, text in enumerate(texts_of(batch.column(batch.num_columns - 1), b"")):
            words = words_of(text)
            if documents and size + len(words) > shard_words:
                yield _one([*rows, others.slice(begun, number - begun)]), Shard(known, documents)
                known, documents, size, rows, begun = Codes(), [], 0, [], number
            documents.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            size += len(words) + 1
        rows.append(others.slice(begun))
    if documents:
        yield _one(rows), Shard(known, documents)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def shard_hits(shard: Shard, block: Block) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Per document of the shard with an occurring window: merged spans of hit words, and the items."""
    asked = shard.code(block.words)
    holes = np.cumsum(np.r_[0, asked < 0])
    whole = np.flatnonzero(holes[block.starts + block.lengths] == holes[block.starts])  # no word is unknown to the shard
    starts, lengths = block.starts[whole], block.lengths[whole]
    low = insertion(shard.codes, shard.order, asked, starts, lengths, after=False)
    high = insertion(shard.codes, shard.order, asked, starts, lengths, after=True)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return {}
    # Equal windows of several items have one range; ranges of windows of one length never overlap.
    ranges, same = np.unique(np.stack([low[hit], high[hit], lengths[hit]], axis=1), axis=0, return_inverse=True)
    same = same.ravel()
    items_of: list[set[str]] = [set() for _ in ranges]
    for one, item in zip(same.tolist(), block.item[whole[hit]].tolist()):
        items_of[one].add(block.items[item])
    counts = ranges[:, 1] - ranges[:, 0]
    window = np.repeat(np.arange(len(ranges)), counts)
    steps = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = shard.order[ranges[window, 0] + steps]
    documents = shard.document(places)
    first = places - shard.starts[documents]
    by = np.lexsort((first, documents))
    documents, window, first = documents[by], window[by], first[by]
    last = first + ranges[window, 2]
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    edges = np.flatnonzero(np.r_[True, documents[1:] != documents[:-1], True])
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        items = set().union(*(items_of[w] for w in set(window[start:end].tolist())))
        found[int(documents[start])] = (merged(zip(first[start:end].tolist(), last[start:end].tolist())), items)
    return found


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _bytes(text: str) -> Column:
    return F.col(text).cast("string").cast("binary")


def _scan(docs: DataFrame, block: Broadcast, window: int, shard_words: int) -> DataFrame:
    """Every document with its hits by one block."""

    def scanned(batches: Batches) -> Batches:
        begin("decontaminate")
        asked = Block(block.value, window)
        for rows, shard in shards_of(in_slices(batches), shard_words):
            found = shard_hits(shard, asked)
            hits = [found.get(number, ((), ())) for number in range(len(shard.sizes))]
            spans = [[{"start": start, "end": end} for start, end in own] for own, _ in hits]
            added = [shard.sizes, spans, [sorted(items) for _, items in hits]]
            fields = [_FOUND_ARROW.field(k) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, f.type) for c, f in zip(added, fields))], schema=_FOUND_ARROW)

    text = _bytes("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(b""))).alias("digest"), text.alias("text"))
    return plain.mapInArrow(scanned, _FOUND)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, digest, n_words, spans, items) per row of ``docs``: words inside a window of the benchmark, and whose.

    A window is ``window`` consecutive words of an item, or all words of a shorter one;
    spans count words of the document from 0, ends exclusive. Null and empty texts have
    no words, on both sides; a null item_id reads as ''. Repeated documents have a row
    each, repeated items count once by id. Other columns are ignored. ``digest`` tells
    texts apart that share an id.
    """
    spark = docs.sparkSession
    scans = [_scan(docs, spark.sparkContext.broadcast(block), window, shard_words) for block in benchmark_blocks(benchmark, window, block_bytes)]
    if len(scans) == 1:
        return scans[0]
    scans = [stored(scan, "benchmark-block") for scan in scans]
    hits = scans[0].filter(F.size("items") > 0).dropDuplicates(["doc_id", "digest"])
    for scan in scans[1:]:
        hits = hits.unionByName(scan.filter(F.size("items") > 0).dropDuplicates(["doc_id", "digest"]))
    gathered = hits.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("text_digest")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items")
    )

    def join_spans(done, span):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["end"])
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, F.array(span)))

    base = scans[0].select("doc_id", "digest", "n_words")
    both = base.join(gathered, base.doc_id.eqNullSafe(gathered.id) & (base.digest == gathered.text_digest), "left")
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    return both.select(
        "doc_id", "digest", "n_words",
        F.aggregate(F.coalesce("all_spans", nothing), nothing, join_spans).alias("spans"),
        F.coalesce("all_items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; all columns stay, and rows keep their partitions."""
    spark, schema = docs.sparkSession, docs.schema

    def cleaned(block: Broadcast):
        def kept(batches: Batches) -> Batches:
            begin("decontaminate")
            segments = Block(block.value, window)
            for rows, shard in shards_of(in_slices(batches), shard_words):
                found = shard_hits(shard, segments)
                clean = [number not in found for number in range(rows.num_rows)]
                yield rows.filter(pa.array(clean, pa.bool_())).rename_columns(schema.names)

        return kept

    for segments in benchmark_blocks(benchmark, window, block_bytes):
        plain = docs.select(*[F.col(f"`{name}`") for name in schema.names], _bytes("text").alias("text of shard"))
        docs = plain.mapInArrow(cleaned(spark.sparkContext.broadcast(segments)), schema)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 10, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, position, length, doc_id, places): the longest verbatim match of each benchmark suffix in the training text.

    ``position`` is the suffix's first word in its item; only matches of ``least`` words
    or more are told. ``doc_id`` is the least id among the longest ones (nulls last) and
    ``places`` how often they occur. An item is read in segments of SEGMENT_WORDS words
    that share ``least`` - 1, so a match ends there and goes on from the next position.
    """
    schema = pa.schema([("item_id", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("places", pa.int64())])

    def matched(block: Broadcast):
        def rows_of(batches: Batches) -> Batches:
            begin("decontaminate")
            segments = block.value
            texts = [words.split(b" ") for _, _, words in segments]
            sizes = np.array([len(words) for words in texts], np.int64)
            ends = np.repeat(np.cumsum(sizes), sizes)
            starts = np.arange(len(ends))
            owner = np.repeat(np.arange(len(segments)), sizes)
            position = starts - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array([start for _, start, _ in segments], np.int64), sizes)
            flat = [word for words in texts for word in words]
            for rows, shard in shards_of(in_slices(batches), shard_words):
                asked = shard.code(flat)
                place = insertion(shard.codes, shard.order, asked, starts, ends - starts, after=False)
                lengths = np.zeros(len(starts), np.int64)
                for neighbour in (place - 1, place):
                    there = (neighbour >= 0) & (neighbour < len(shard.order))
                    at = shard.order[np.clip(neighbour, 0, len(shard.order) - 1)]
                    common = compared(shard.codes, at, asked, starts, np.where(there, ends - starts, 0))[0]
                    lengths = np.maximum(lengths, common)
                long = np.flatnonzero(lengths >= least)
                low = insertion(shard.codes, shard.order, asked, starts[long], lengths[long], after=False)
                high = insertion(shard.codes, shard.order, asked, starts[long], lengths[long], after=True)
                ids = rows.column(0).to_pylist()
                by_order = [np.unique(shard.document(shard.order[a:b])) for a, b in zip(low.tolist(), high.tolist())]
                first = [min((ids[d] for d in found.tolist() if ids[d] is not None), default=None) for found in by_order]
                out = [[segments[o][0] for o in owner[long].tolist()], position[long], lengths[long], first, high - low]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        return rows_of

    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes("text").alias("text"))
    found = None
    for segments in benchmark_blocks(benchmark, least, block_bytes):
        more = plain.mapInArrow(matched(spark.sparkContext.broadcast(segments)), "item_id string, position long, length long, doc_id long, places long")
        found = more if found is None else found.unionByName(more)
    longest = found.groupBy("item_id", "position", "length").agg(F.min("doc_id").alias("doc_id"), F.sum("places").alias("places"))
    best = F.max_by(F.struct("length", "doc_id", "places"), "length").alias("best")
    return longest.groupBy("item_id", "position").agg(best).select("item_id", "position", "best.*")
