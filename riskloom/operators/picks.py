"""Picking one row per key, paging and sampling.

Picks are aggregates over structs, not windows: they combine before the shuffle,
so a key that holds a third of all rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, stored


def greatest_row(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; remaining columns break ties, so the pick is total."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in order + rest]).select(*rows.columns)


def without_repeats(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``greatest_row`` where next to no key repeats: only rows whose key may repeat are shuffled.

    Hashes of the keys are counted, and those that occur more than once are stored first, so
    that a short list of them goes to the rows. A hash that two keys share costs a shuffle of their rows, no more.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_hash")
    repeated = stored(repeated, "repeated-keys")
    several = greatest_row(hashed.join(repeated, "_hash", "left_semi").drop("_hash"), [key], order)
    return hashed.join(repeated, "_hash", "left_anti").drop("_hash").unionByName(several)


def counted_once(rows: DataFrame, keys: list[str], id_column: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``, whose sum per ``keys`` is the number of distinct non-null ids, and rows of keys, id and flag alone.

    Next to no id comes twice for the same keys, so only hashes are shuffled to tell which may;
    those that occur more than once are stored, and only their ids are made distinct, in the rows
    that are added. All other columns are null there, so that sums and maxima do not see them.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*keys, id_column))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_hash")
    repeated = stored(repeated, "repeated-ids")
    alone = F.col(id_column).isNotNull() & F.col("_again").isNull()
    marked = hashed.join(repeated.withColumn("_again", F.lit(True)), "_hash", "left").withColumn(flag, alone.cast("long"))
    several = hashed.join(repeated, "_hash", "left_semi").filter(F.col(id_column).isNotNull()).select(*keys, id_column).distinct()
    return marked.drop("_hash", "_again").unionByName(several.withColumn(flag, F.lit(1).cast("long")), allowMissingColumns=True)


def newest_rows(profile: DataFrame) -> DataFrame:
    """``latest_per_employer`` of a whole serving table, where next to no employer has several rows: they are not shuffled."""
    return without_repeats(profile, "employer_id", ["snapshot_date"])


def latest_per_employer(profile: DataFrame) -> DataFrame:
    """Newest snapshot row of each employer. Filter before calling, as the served queries do."""
    return greatest_row(profile, ["employer_id"], ["snapshot_date"])


def at_latest_snapshot(profile: DataFrame) -> DataFrame:
    """Rows of the newest snapshot; the date is a scalar subquery, so the scan can prune by it."""
    return profile.filter(F.col("snapshot_date") == profile.agg(F.max("snapshot_date")).scalar())


# Pages of at most so many rows are read at once, with their total, in a single pass over the rows.
PAGE_ROWS = 10_000


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of ``rows`` with the total number of rows. ``order`` must end in a unique key.

    Each task sorts out the ``offset + limit`` rows that may be on the page; nothing is
    stored. A page of up to PAGE_ROWS rows is read here, the total counted on the way; of
    a longer one the total is a scalar subquery, which evaluates the rows once more.
    """
    if limit > PAGE_ROWS:
        total = rows.agg(F.count(F.lit(1))).scalar()
        return _cut(rows.orderBy(*order), limit, offset).withColumn("total_count", total)
    seen = Observation()
    found = _cut(rows.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order), limit, offset).collect()
    return rows.sparkSession.createDataFrame(found, rows.schema).withColumn("total_count", F.lit(seen.get["n"]).cast("long"))


def _cut(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(
    rows: DataFrame, order: dict[str, bool], limit: int, after: dict | DataFrame | None = None
) -> tuple[DataFrame, Observation]:
    """The ``limit`` rows that follow the row ``after``, and an observation of the total as ``total_count``.

    ``order`` names columns and whether they descend, nulls last either way; the last
    one is unique and not null. ``after`` holds these columns of the last row of the
    page before (None: the first page). The rows are evaluated once: all are counted on
    the way, only those behind the cursor are kept, and each task holds ``limit`` of
    them. The observation's value is there once the page has been read.

    With a DataFrame of cursors (page, columns of the order), each a row of ``rows`` as
    ``page_ends`` finds them, the pages behind all of them come at once, with ``page`` and
    ``place`` (from 0): one sort and one join, however many pages there are.
    """
    total = Observation()
    if isinstance(after, DataFrame):
        key, every = list(order)[-1], numbered(rows, order)
        starts = every.select(key, "row_no").join(
            after.select("page", F.col(key).alias("_cursor")), F.col(key).eqNullSafe(F.col("_cursor"))
        ).select("page", (F.col("row_no") + 1).alias("first"))
        # A page lies in the block of its first row and in the next one.
        block = F.floor(F.col("first") / limit)
        starts = starts.withColumn("block", F.explode(F.array(block, block + 1)))
        counted = every.observe(total, F.count(F.lit(1)).alias("total_count")).withColumn("block", F.floor(F.col("row_no") / limit))
        found = counted.join(starts, "block").withColumn("place", F.col("row_no") - F.col("first"))
        return found.filter((F.col("place") >= 0) & (F.col("place") < limit)).drop("block", "first", "row_no"), total
    counted = rows.observe(total, F.count(F.lit(1)).alias("total_count"))
    behind = counted.filter(_follows(order, after)) if after else counted
    return behind.orderBy(*sorting(order)).limit(limit), total


def page_ends(rows: DataFrame, order: dict[str, bool], limit: int) -> DataFrame:
    """Cursors (page, columns of the order) of all pages but the first: the last row of the page before each."""
    every = numbered(rows.select(*order), order).withColumn("page", F.floor(F.col("row_no") / limit) + 1)
    return every.filter(F.col("row_no") % limit == limit - 1).drop("row_no")


def numbered(rows: DataFrame, order: dict[str, bool]) -> DataFrame:
    """``rows`` with ``row_no``, their place in the order from 0.

    The sorted rows are kept, so their partitions stay: a place in its partition and the
    rows of the partitions before it make the number, and no task sees them all.
    """
    ordered = cut_lineage(rows.orderBy(*sorting(order)))
    placed = ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    before, sizes = 0, []
    for row in sorted(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        sizes.append((row["_part"], before))
        before += row["n"]
    offsets = rows.sparkSession.createDataFrame(sizes, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def sorting(order: dict[str, bool]) -> list[Column]:
    return [F.desc_nulls_last(name) if descending else F.asc_nulls_last(name) for name, descending in order.items()]


def _follows(order: dict[str, bool], after: dict) -> Column:
    """Rows that come later than the cursor in the given order."""
    later, equal = F.lit(False), F.lit(True)
    for name, descending in order.items():
        value, column = F.lit(after[name]), F.col(name)
        if after[name] is None:  # only nulls are left in this column
            beyond, same = F.lit(False), column.isNull()
        else:
            beyond = column.isNull() | (column < value if descending else column > value)
            same = F.coalesce(column == value, F.lit(False))
        later, equal = later | (equal & beyond), equal & same
    return later


def repeatable_sample(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows chosen by a hash of their key: random to look at, the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))), key).limit(k)
