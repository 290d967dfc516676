"""Exact set-similarity joins on trigrams.

Pairs above a Jaccard threshold must share one of their rarest trigrams: of a set of
n, all but the ``ceil(t*n) - 1`` most frequent ones. Only those are exploded and
equi-joined, in rows of fixed width: ids, set size, position and a bit sketch of the
set. Sizes, positions and sketches discard most candidates there; the sets themselves
meet the rest by id. Nothing is dropped that could pass.

``best_matches`` wants only the most similar text per query. It lowers the threshold
level by level and asks again only for queries that have found nothing above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.similarity import trigrams
from riskloom.session import cut_lineage

# Grams are counted in this many buckets, which bounds what the driver reads back.
# Grams that share a bucket only make the order of rarity less sharp.
FREQUENCY_BUCKETS = 1 << 14
_STEPS = 8
_SKETCH_WORDS = 2
# Thresholds that a best match is looked for at before the one asked for.
LEVELS = (0.7,)


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(FREQUENCY_BUCKETS)).cast("int")


def frequency_classes(grams: DataFrame) -> Column:
    """One byte per bucket: eighths of the binary logarithm of how many texts hold its grams."""
    counted = (
        grams.select(F.explode("grams").alias("gram"))
        .groupBy(_bucket(F.col("gram")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    classes = bytearray(FREQUENCY_BUCKETS)
    for row in counted:
        classes[row["bucket"]] = min(255, 1 + math.floor(_STEPS * math.log2(row["n"])))
    return F.lit(bytes(classes))


def _class(classes: Column, gram: Column) -> Column:
    return F.conv(F.hex(F.substring(classes, _bucket(gram) + 1, 1)), 16, 10).cast("int")


def _sketch(grams: Column, word: int) -> Column:
    """64 bits of which each is set when some gram asks for it: one word of the sketch."""
    bit = lambda g: F.pmod(F.shiftrightunsigned(g, 20), F.lit(64 * _SKETCH_WORDS)).cast("int")
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.filter(grams, lambda g: F.floor(bit(g) / 64) == word), F.lit(0).cast("long"),
        lambda bits, g: bits.bitwiseOR(F.call_function("shiftleft", one, F.pmod(bit(g), F.lit(64)))),
    )


class NameSets:
    """Trigram sets of the distinct texts of both sides, each computed once, the rarest grams first.

    ``queries`` and ``targets`` have one row per text: id (a hash of the text), the text
    itself, its grams (64-bit hashes) with their frequency classes on either side, the
    size of the set and its sketch words.
    """

    def __init__(self, queries: DataFrame, targets: DataFrame, query_text: str, target_text: str) -> None:
        hashed = [cut_lineage(self._hashed(queries, query_text)), cut_lineage(self._hashed(targets, target_text))]
        often = [frequency_classes(side) for side in hashed]
        # The filter follows the checkpoint: a constraint on the grams would be carried over to whatever joins the texts.
        self.queries, self.targets = (cut_lineage(self._ranked(side, *often)).filter("size > 0") for side in hashed)

    @staticmethod
    def _hashed(texts: DataFrame, text: str) -> DataFrame:
        grams = F.transform(trigrams(F.col(text)), lambda g: F.xxhash64(g))
        return texts.select(text).distinct().withColumn("grams", F.array_distinct(grams))

    @staticmethod
    def _ranked(texts: DataFrame, q_often: Column, t_often: Column) -> DataFrame:
        text = texts.columns[0]
        told = F.transform("grams", lambda g: F.struct(_class(t_often, g).alias("t"), g.alias("gram"), _class(q_often, g).alias("q")))
        words = [_sketch(F.col("grams"), w).alias(f"bits{w}") for w in range(_SKETCH_WORDS)]
        return texts.select(F.xxhash64(text).alias("id"), text, F.sort_array(told).alias("ranked"), F.size("grams").alias("size"), *words)


def _blocked(rows: DataFrame, text: str, sets: DataFrame, keys: list[str]) -> DataFrame:
    """The ids of the texts, per block if there are blocks."""
    return rows.select(*keys, text).distinct().join(sets.select("id", text), text).select(*keys, "id")


def candidates(
    sets: NameSets, asked: DataFrame, held: DataFrame, threshold: float, block: str | None, rows_per_salt: int
) -> DataFrame:
    """Distinct (block, q_id, t_id) that may lie above ``threshold``, from ``asked`` and ``held``, (block, id) each.

    A gram that many texts of a block share on either side is split over salts of both
    sides, as many as the smaller of its own and the block's frequency asks for.
    """
    keys = [block] if block else []
    if block:
        counts = [rows.groupBy(block).agg(F.count(F.lit(1)).alias(n)) for rows, n in ((asked, "n_q"), (held, "n_t"))]
        sizes = counts[0].join(counts[1], block)

    def salts(side: str) -> Column:
        upper = F.pow(F.lit(2.0), F.col(f"g.{side}") / _STEPS)
        upper = F.least(upper, F.col(f"n_{side}").cast("double")) if block else upper
        return (upper / rows_per_salt).cast("int") + 1

    def probes(rows: DataFrame, own: DataFrame, side: str) -> DataFrame:
        prefix = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
        bits = [F.col(f"bits{w}").alias(f"{side}_bits{w}") for w in range(_SKETCH_WORDS)]
        words = [f"bits{w}" for w in range(_SKETCH_WORDS)]
        placed = rows.join(sizes, block) if block else rows
        exploded = placed.join(own.select("id", "size", "ranked", *words), "id").select(
            *keys, *(["n_q", "n_t"] if block else []), F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size"), *bits,
            F.posexplode(F.slice("ranked", F.lit(1), prefix)).alias(f"{side}_at", "g"),
        )
        other = "t" if side == "q" else "q"
        kept = [*keys, F.col("g.gram").alias("gram"), f"{side}_id", f"{side}_size", f"{side}_at", *[f"{side}_{w}" for w in words]]
        return exploded.select(
            *kept, F.pmod(F.xxhash64(f"{side}_id"), salts(side)).cast("int").alias(f"{side}_salt"),
            F.explode(F.sequence(F.lit(0), salts(other) - 1)).alias(f"{other}_salt"),
        )

    needed = F.ceil((F.col("q_size") + F.col("t_size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))

    def at_most(side: str, other: str) -> Column:
        """Grams of one set that the other may hold: not those whose bit the other lacks."""
        lacking = [F.bit_count(F.col(f"{side}_bits{w}").bitwiseAND(F.bitwise_not(F.col(f"{other}_bits{w}")))) for w in range(_SKETCH_WORDS)]
        return F.col(f"{side}_size") - sum(lacking[1:], lacking[0])

    may_be = (
        (F.least(F.col("q_size") - F.col("q_at"), F.col("t_size") - F.col("t_at")) >= needed)
        & (F.col("t_size") >= F.col("q_size") * threshold - 1e-9)
        & (F.col("q_size") >= F.col("t_size") * threshold - 1e-9)
        & (at_most("q", "t") >= needed) & (at_most("t", "q") >= needed)
    )
    q, t = probes(asked, sets.queries, "q"), probes(held, sets.targets, "t")
    return q.join(t, [*keys, "gram", "q_salt", "t_salt"]).filter(may_be).select(*keys, "q_id", "t_id").distinct()


def verified(sets: NameSets, found: DataFrame, threshold: float) -> DataFrame:
    """``found`` with the texts and the exact similarity, above ``threshold`` only. Each pair of texts is compared once."""
    q_text, t_text = sets.queries.columns[1], sets.targets.columns[1]
    q = sets.queries.select(F.col("id").alias("q_id"), q_text, F.col("ranked.gram").alias("q_grams"))
    t = sets.targets.select(F.col("id").alias("t_id"), t_text, F.col("ranked.gram").alias("t_grams"))
    shared = F.size(F.array_intersect("q_grams", "t_grams"))
    return (
        found.join(q, "q_id").join(t, "t_id").withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.size("q_grams") + F.size("t_grams") - F.col("shared")))
        .filter(F.col("similarity") > threshold).drop("q_grams", "t_grams", "shared")
    )


def similar_pairs(
    queries: DataFrame,
    targets: DataFrame,
    query_text: str,
    target_text: str,
    threshold: float,
    block: str | None = None,
    rows_per_salt: int = 50_000,
) -> DataFrame:
    """Distinct pairs of a query text and a target text with trigram similarity above ``threshold`` (> 0).

    (block, query text, target text, similarity). With ``block``, only rows with equal
    block values pair. Grams are compared by their 64-bit hashes.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    sets = NameSets(queries, targets, query_text, target_text)
    keys = [block] if block else []
    asked, held = _blocked(queries, query_text, sets.queries, keys), _blocked(targets, target_text, sets.targets, keys)
    pairs = verified(sets, candidates(sets, asked, held, threshold, block, rows_per_salt), threshold)
    return pairs.select(*keys, query_text, target_text, "similarity")


def best_matches(
    asked: DataFrame, held: DataFrame, query_text: str, target_text: str, query_key: str, target_key: str,
    threshold: float, block: str, rows_per_salt: int = 50_000,
) -> DataFrame:
    """(query_key, target_key, similarity): per query the most similar target of its blocks above ``threshold``.

    ``asked`` has (block, query_text, query_key), a query in one block or several;
    ``held`` (block, target_text, target_key), where one key per block and text, the
    least, is enough. Ties go to the least target key. Equal gram sets are looked for
    first, then pairs above each of LEVELS, then all: whatever a query finds above a
    level is above all that it could find below, so it is asked no further.
    """
    asked, held = cut_lineage(asked.select(block, query_text, query_key)), cut_lineage(held.select(block, target_text, target_key))
    asked = asked.join(held.select(block).distinct(), block, "left_semi")
    sets = NameSets(asked, held, query_text, target_text)
    keyed = asked.join(sets.queries.select(query_text, F.col("id").alias("q_id")), query_text).select(block, "q_id", query_key)
    owned = held.join(sets.targets.select(target_text, F.col("id").alias("t_id")), target_text).select(block, "t_id", target_key)
    owned, open_, solved = cut_lineage(owned), cut_lineage(keyed), []
    for level in (1.0, *[x for x in LEVELS if x > threshold], threshold):
        if level == 1.0:
            same = F.xxhash64(F.array_sort("ranked.gram"))
            q, t = (side.select(F.col("id").alias(name), "size", same.alias("same")) for side, name in ((sets.queries, "q_id"), (sets.targets, "t_id")))
            twins = q.join(t, ["same", "size"]).select("q_id", "t_id")
            found = open_.select(block, "q_id").distinct().join(twins, "q_id").join(owned.select(block, "t_id").distinct(), [block, "t_id"], "left_semi")
            pairs = verified(sets, found, 1.0 - 1e-9)
        else:
            now = [side.select(block, F.col(name).alias("id")).distinct() for side, name in ((open_, "q_id"), (owned, "t_id"))]
            pairs = verified(sets, candidates(sets, *now, level, block, rows_per_salt), level)
        best = F.min_by(F.struct(target_key, "similarity"), F.struct(-F.col("similarity"), F.col(target_key))).alias("best")
        hits = open_.join(pairs.select(block, "q_id", "t_id", "similarity"), [block, "q_id"]).join(owned, [block, "t_id"])
        solved.append(cut_lineage(hits.groupBy(query_key).agg(best).select(query_key, f"best.{target_key}", "best.similarity")))
        open_ = open_.join(solved[-1].select(query_key), query_key, "left_anti")
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out
