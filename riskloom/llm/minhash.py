"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

A document's set holds the hashes of its distinct word shingles. Documents with the
same set form a class at once, so copies cost one row from there on. Classes that
agree in a band of their signatures share a bucket. Buckets are never expanded into
all pairs: every member is first verified against one member of its bucket (twice,
by two choices of that member), and only members that are then still in different
components are compared among themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import GOLDEN, MASK, Batches, begin, held, in_slices, mix, stored, texts_of
from riskloom.operators.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("pick", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())),
])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_VALUE_BITS = np.uint64(40)
_VALUE_MASK = np.uint64((1 << 40) - 1)
_SLOT_BITS = np.uint64(24)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = held("minhash", WordHashes())


def shingle_set(text: str, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``, A-Z lower-cased, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    count = len(words)
    if not count:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, count)
    width = min(words_per_shingle, count)
    shingles = np.full(count - width + 1, width, np.uint64)
    for i in range(width):
        shingles = mix(shingles * np.uint64(0x100000001B3) + hashes[i : count - width + 1 + i])
    return np.unique(shingles)


def super_minhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signature of a non-empty set of 64-bit hashes.

    Each element walks its own random permutation of the slots; its value at step j
    is j plus a random fraction. Once every slot holds a value of a past step, later
    steps cannot lower any slot and the walk stops.
    """
    count = len(elements)
    signature = np.full(slots, np.uint64(MASK))
    dense = count * slots <= 1 << 16
    if dense:
        order = np.tile(np.arange(slots, dtype=np.int64), (count, 1))
        rows = np.arange(count)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        random = mix(elements + np.uint64((j + 1) * GOLDEN & MASK))
        chosen = j + ((random >> _VALUE_BITS) * np.uint64(slots - j) >> _SLOT_BITS).astype(np.int64)
        if dense:
            slot = order[rows, chosen]
            order[rows, chosen] = order[:, j]
        else:  # few steps: follow the earlier swaps back instead of holding every permutation
            slot = chosen
            for i in range(j - 1, -1, -1):
                slot = np.where(slot == swaps[i], i, slot)
            swaps.append(chosen)
        np.minimum.at(signature, slot, np.uint64(j) << _VALUE_BITS | random & _VALUE_MASK)
        if int(signature.max()) < (j + 1) << 40:
            break
    return signature


def rows_per_band(percent: int, bands: int, miss: float = 1e-6) -> int:
    """The longest bands with which a pair at the threshold shares no bucket with probability ``miss`` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** bands <= miss)


def document_features(docs: DataFrame, words_per_shingle: int, percent: int, bands: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, one key per band; the last two null for an empty set."""
    rows = rows_per_band(percent, bands)

    def features(batches: Batches) -> Batches:
        begin("minhash")
        for batch in in_slices(batches):
            out: list[list] = [[], [], []]
            for text in texts_of(batch.column(2)):
                shingles = shingle_set(text, words_per_shingle)
                out[0].append(len(shingles))
                if not len(shingles):
                    for column in out[1:]:
                        column.append(None)
                    continue
                signature = super_minhash(shingles, bands * rows)
                keys = np.arange(bands, dtype=np.uint64)
                for column in signature.reshape(bands, rows).T:
                    keys = mix(keys * np.uint64(0x100000001B3) + column)
                out[1].append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                out[2].append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(out, list(_FEATURES)[2:]))], schema=_FEATURES)

    plain = _texts(docs).withColumnRenamed("id", "doc_id")
    return plain.mapInArrow(features, "doc_id long, pick long, n_shingles long, digest binary, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("pick"), text.alias("text"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, bands: int = 36) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of documents linked when 100 * |A & B| >= percent * |A | B|.

    Null and empty texts, or texts of white space only, have an empty set and link
    with nothing. Rows repeated with one doc_id count as one document, the one
    whose text has the greatest hash. Null ids are left out. Other columns are ignored. A pair
    just at the threshold is missed with a probability of about one in a million;
    every link is confirmed on the full sets of 64-bit shingle hashes.
    """
    features = document_features(docs.filter(F.col("doc_id").isNotNull()), words_per_shingle, percent, bands)
    features = stored(features, "minhash-features")
    single = features.groupBy("doc_id").agg(F.max(F.struct("pick", "n_shingles", "digest")).alias("s")).select("doc_id", "s.*")
    filled = single.filter("n_shingles > 0")
    classes = stored(filled.groupBy("digest", "n_shingles").agg(F.min(F.struct(F.col("doc_id").alias("id"), "pick")).alias("s")).select("digest", "s.*"), "minhash-classes")
    of_class = features.join(classes.select(F.col("id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    of_class = stored(of_class.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands"), "minhash-of-class")

    members = of_class.select("id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("pivot")).filter("size > 1")
    buckets = stored(members.join(shared, "key"), "minhash-buckets")
    texts, picks = _texts(docs), classes.select("id", "pick")

    def fits(n: str, other: str) -> F.Column:
        return F.least(n, other) * 100 >= F.greatest(n, other) * percent

    star = buckets.filter(F.col("id") != F.col("pivot.id")).filter(fits("n", "pivot.n")).select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))
    links = stored(verified(star.distinct(), texts, picks, words_per_shingle, percent), "minhash-links")
    component = stored(_components(links), "minhash-components")

    # The same from another member, among what is still apart.
    apart = _mixed(buckets, component)
    chosen = F.min_by(F.struct("id", "n", "component"), F.xxhash64("id", "key")).alias("pivot")
    pivots = apart.groupBy("key").agg(chosen)
    star = apart.join(pivots, "key").filter(F.col("component") != F.col("pivot.component")).filter(fits("n", "pivot.n"))
    star = star.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
    links = links.unionByName(stored(verified(star, texts, picks, words_per_shingle, percent), "minhash-links"))
    component = stored(_components(links), "minhash-components")

    rest = stored(remaining_pairs(_mixed(buckets, component), of_class, texts, picks, words_per_shingle, percent), "minhash-rest")
    links = links.unionByName(stored(verified(rest, texts, picks, words_per_shingle, percent), "minhash-links"))
    component = stored(_components(links), "minhash-components")

    labelled = classes.join(component.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("digest", F.coalesce("component", "id").alias("component_id"))
    return (
        single.join(labelled, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("pick").alias("text_hash"))
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_hash")
    )


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.distinct(), "a", "b")


def _mixed(buckets: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component."""
    labelled = buckets.select("key", "id", "n").join(component.withColumnRenamed("node", "id"), "id", "left")
    labelled = stored(labelled.withColumn("component", F.coalesce("component", "id")), "minhash-labelled")
    spread = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    return labelled.join(spread.filter("low < high").select("key", "size"), "key")


def short_sets(ids: DataFrame, texts: DataFrame, picks: DataFrame, words_per_shingle: int) -> DataFrame:
    """(id, short): the set of each id with its hashes cut to 32 bits."""

    def short(batches: Batches) -> Batches:
        begin("minhash")
        for batch in in_slices(batches):
            sets = [shingle_set(text, words_per_shingle).astype("<u4").tobytes() for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "short"])

    asked = ids.join(picks, "id").join(texts, ["id", "pick"]).select("id", "text")
    return asked.mapInArrow(short, "id long, short binary").dropDuplicates(["id"])


def remaining_pairs(mixed: DataFrame, of_class: DataFrame, texts: DataFrame, picks: DataFrame, words_per_shingle: int, percent: int, cell: int = 256) -> DataFrame:
    """Pairs (a, b) of a bucket that join different components, for a last check on the full sets.

    A bucket is cut into cells of about ``cell`` members and every two cells meet in
    one group, so that no task holds a bucket. Two members are compared in the first
    of the bands they share only. Shortened hashes can but raise an intersection, so
    no link is lost by them; where a link would stand even with three shingles less in
    common, and eight deviations more than the accidents to be expected in sets of their
    sizes, further links between the components that it joins are not returned.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col("size") / cell)).cast("int")
    dealt = mixed.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    meeting = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda other: F.struct(F.least("cell", other).alias("i"), F.greatest("cell", other).alias("j")),
    )
    dealt = stored(dealt.withColumn("at", F.explode(meeting)).select("key", "at.i", "at.j", "cell", "id", "n", "component"), "minhash-dealt")
    sets = short_sets(dealt.select("id").distinct(), texts, picks, words_per_shingle).join(of_class.select("id", "bands"), "id")

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band_key, i, j = key
        bands = np.stack(rows["bands"].to_list())
        earlier = bands[:, : int(np.flatnonzero(bands[0] == band_key)[0])]
        ids, sizes, component, cell_of = (rows[c].to_numpy() for c in ("id", "n", "component", "cell"))
        asked = []
        for x in np.flatnonzero(cell_of == i):
            near = (component != component[x]) & (cell_of == j) & (np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * percent)
            if i == j:
                near &= ids > ids[x]
            at = np.flatnonzero(near)
            at = at[~(earlier[at] == earlier[x]).any(axis=1)]
            if len(at):
                asked.append((x, at))
        found: list[tuple[int, int]] = []
        if not asked:
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        shorts = [np.frombuffer(x, "<u4") for x in rows["short"]]
        starts = np.cumsum([0, *map(len, shorts)])
        known, codes = np.unique(np.concatenate(shorts), return_inverse=True)
        flags = np.zeros(len(known), bool)
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for x, at in asked:
            own = codes[starts[x] : starts[x + 1]]
            flags[own] = True
            both = np.add.reduceat(flags[codes], starts[:-1], dtype=np.int64)[at]
            flags[own] = False
            total = sizes[at] + sizes[x]
            linked = 100 * both >= percent * (total - both)
            chance = sizes[at] * sizes[x] / 2**32  # shortened hashes that agree by accident, on average
            slack = 3 + np.ceil(chance + 8 * np.sqrt(chance))
            sure = 100 * (both - slack) >= percent * (total - both + slack)
            for y, certain in zip(at[linked].tolist(), sure[linked].tolist()):
                if certain:
                    one, two = find(int(component[x])), find(int(component[y]))
                    if one == two:
                        continue
                    root[max(one, two)] = min(one, two)
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "id").groupBy("key", "i", "j").applyInPandas(pairs, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, picks: DataFrame, words_per_shingle: int, percent: int, per_group: int = 500) -> DataFrame:
    """Of the distinct ``pairs`` (a, b), those whose full sets meet the threshold.

    Texts come to the pairs by id, and each group of pairs with one ``a`` is read as a
    sorted stream, ``a`` itself first. A larger group is dealt over several keys.
    """
    pairs = stored(pairs, "minhash-pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("int").alias("parts"))
    others = pairs.join(sizes.filter("parts > 1"), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b")
    firsts = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("a").alias("b"))
    asked = others.unionByName(firsts).withColumnRenamed("b", "id").join(picks, "id")
    rows = asked.join(texts, ["id", "pick"]).withColumnRenamed("id", "b")
    rows = rows.select("a", "part", (F.col("b") != F.col("a")).alias("later"), "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "later").select("a", "b", "text")

    def judged(batches: Batches) -> Batches:
        begin("minhash")
        first, base = None, np.empty(0, np.uint64)
        for batch in in_slices(batches):
            out: list[list] = [[], []]
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                own = shingle_set(text, words_per_shingle)
                if a == b:
                    first, base = a, own
                    continue
                assert a == first, "the first member of a group precedes the others"
                both = len(np.intersect1d(base, own, assume_unique=True))
                if len(own) and 100 * both >= percent * (len(base) + len(own) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_pydict({"a": out[0], "b": out[1]}, schema=_LINK)

    return rows.mapInArrow(judged, "a long, b long")
