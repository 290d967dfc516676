"""A stored inverted index of names: per trigram the names that hold it, one delta per snapshot.

``{root}/postings`` is partitioned by snapshot and slot (a hash of the gram); a row is a
gram with up to LIST_SIZE name ids and the sizes of their gram sets, and files are sorted
by gram. ``{root}/names`` lists the ids already indexed. A snapshot adds the names that no
earlier one had. A search reads how long the lists of its own grams are, then only the
shortest ones that any name above the threshold must be in, and compares the names that
are left. Names that no employer carries any more find no row and do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.similarity import trigrams, trigram_similarity

SLOTS = 16
LIST_SIZE = 4096
_POSTINGS = "gram string, held int, entries array<struct<id: long, size: int>>, snapshot date, slot int"


def name_id(name: Column) -> Column:
    """Id of a name, upper and lower case alike. Names that share one are told apart when they are compared."""
    return F.xxhash64(F.lower(name))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def add_to_index(profile: DataFrame, root: str, name: str = "employer_name") -> int:
    """Index the names of each snapshot of ``profile`` that is not indexed yet, oldest first; the number of names added.

    A snapshot's names are appended only after its postings, so a run that broke off
    between the two is repeated: postings of the same snapshot are replaced.
    """
    spark, added = profile.sparkSession, 0
    days = [row[0] for row in profile.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]
    for day in days:
        known = spark.read.parquet(f"{root}/names") if _exists(spark, f"{root}/names") else None
        if known is not None and known.filter(F.col("snapshot") == str(day)).limit(1).count():
            continue
        fresh = profile.filter((F.col("snapshot_date") == F.lit(day)) & F.col(name).isNotNull()).select(F.lower(name).alias("name")).distinct()
        fresh = fresh.withColumn("id", name_id(F.col("name")))
        if known is not None:
            fresh = fresh.join(known.select("name").distinct(), "name", "left_anti")
        grams = fresh.withColumn("grams", trigrams(F.col("name"))).select("id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        # A list is cut by the hash of its names, so that a gram of a third of all names is no single row.
        lists = grams.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / LIST_SIZE).cast("int").alias("parts"))
        cut = grams.join(lists, "gram").groupBy("gram", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(
            F.sort_array(F.collect_list(F.struct("id", "size"))).alias("entries")
        )
        rows = cut.select("gram", F.size("entries").alias("held"), "entries", _slot(F.col("gram")).alias("slot"))
        rows.repartition(SLOTS, "slot").sortWithinPartitions("slot", "gram").write.mode("overwrite").partitionBy("slot").parquet(f"{root}/postings/snapshot={day}")
        fresh.select("id", "name").write.mode("overwrite").parquet(f"{root}/names/snapshot={day}")
        added += spark.read.parquet(f"{root}/names/snapshot={day}").count()
    return added


def query_grams(spark: SparkSession, name: str) -> list[tuple[str, int]]:
    """The grams of a searched name with their slots; a one-row plan that needs no job."""
    asked = F.transform(trigrams(F.lit(name)), lambda g: F.struct(g.alias("gram"), _slot(g).alias("slot")))
    return [(row["gram"], row["slot"]) for row in spark.sql("SELECT 1 AS one").select(asked.alias("asked")).first()["asked"]]


def rarest_lists(postings: DataFrame, grams: list[tuple[str, int]], threshold: float) -> list[tuple[str, int]]:
    """The shortest lists that a name above ``threshold`` must be in at least once."""
    names = [gram for gram, _ in grams]
    stored = postings.filter(F.col("slot").isin([slot for _, slot in grams]) & F.col("gram").isin(names))
    held = {row["gram"]: row["n"] for row in stored.groupBy("gram").agg(F.sum("held").alias("n")).collect()}
    must = int(-(-round(threshold * len(grams), 9) // 1))  # a name above it shares so many grams at least
    return sorted(grams, key=lambda g: (held.get(g[0], 0), g[0]))[: len(grams) - max(must, 1) + 1]


def candidate_names(spark: SparkSession, root: str, name: str, threshold: float) -> DataFrame:
    """Ids of the indexed names that may be similar to ``name`` above ``threshold`` (> 0)."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    grams = query_grams(spark, name)
    postings = spark.read.schema(_POSTINGS).parquet(f"{root}/postings")
    chosen = rarest_lists(postings, grams, threshold) if grams else []
    wanted = postings.filter(F.col("slot").isin([slot for _, slot in chosen]) & F.col("gram").isin([gram for gram, _ in chosen]))
    entries = wanted.select(F.explode("entries").alias("e")).select("e.id", "e.size")
    at_most = F.count(F.lit(1)) + len(grams) - len(chosen)
    needed = F.ceil((F.lit(len(grams)) + F.col("size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    return entries.groupBy("id", "size").agg(at_most.alias("shared")).filter(F.col("shared") >= needed).select("id").distinct()


def similar_rows(profile: DataFrame, root: str, name: str, threshold: float, also: Column | None = None) -> DataFrame:
    """Rows of ``profile`` whose employer_name is similar to ``name`` above ``threshold``, with ``sim_score``.

    Rows that meet ``also`` come with their score, whatever it is. Only names that the
    index lets through are compared.
    """
    found = candidate_names(profile.sparkSession, root, name, threshold).select(F.col("id").alias("_name_id"), F.lit(True).alias("_indexed"))
    rows = profile.withColumn("_name_id", name_id(F.col("employer_name")))
    near = rows.join(found, "_name_id", "inner" if also is None else "left")
    kept = F.col("_indexed") if also is None else F.col("_indexed") | F.coalesce(also, F.lit(False))
    scored = near.filter(kept).withColumn("sim_score", trigram_similarity(F.col("employer_name"), F.lit(name)))
    above = F.col("sim_score") > threshold
    return scored.filter(above if also is None else above | F.coalesce(also, F.lit(False))).drop("_name_id", "_indexed")
