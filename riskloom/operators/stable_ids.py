"""Employer ids that survive re-clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.codes import uuid_from_text
from riskloom.session import cut_lineage


def assign_stable_ids(previous_ids: DataFrame, previous_clusters: DataFrame, clusters: DataFrame, run: str = "") -> DataFrame:
    """(employer_id, cluster_id) for every cluster of the new run.

    Larger clusters choose first (ties: least cluster id): the id their cluster_id
    had before, else the id they share most members with, else a new one; an id is
    given once. Clusters propose and an id keeps its largest proposer, until nobody
    is turned away. As all ids rank clusters alike, that is the result of choosing
    one after another. A new id is made of the cluster's least member and ``run``:
    where runs follow each other, each needs a name of its own, or a cluster that
    lost its id to another could be given the same one as new. Members and ids are not
    broadcast, however short the files they come from.
    """
    active = previous_ids
    if "superseded_by" in previous_ids.columns:
        active = previous_ids.filter(F.col("superseded_by").isNull())
    active = active.groupBy("cluster_id").agg(F.min("employer_id").alias("employer_id"))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.min("unique_id").alias("first_member"))
    overlap = _overlap(active, previous_clusters, clusters)
    favourite = overlap.groupBy("cluster_id").agg(
        F.min_by("employer_id", F.struct(-F.col("shared"), F.col("employer_id"))).alias("favourite")
    )
    wishes = F.array_distinct(F.array_compact(F.array("employer_id", "favourite")))
    state = cut_lineage(
        sizes.join(active.hint("merge"), "cluster_id", "left")
        .join(favourite, "cluster_id", "left")
        .select("cluster_id", "members", "first_member", wishes.alias("wishes"), F.lit(0).alias("at"))
    )
    wish = F.try_element_at("wishes", F.col("at") + 1)
    while True:  # every refusal moves a cluster on along its wishes, so refusals end
        proposing = state.withColumn("wish", wish)
        kept = proposing.filter(F.col("wish").isNotNull()).groupBy("wish").agg(
            F.min_by("cluster_id", F.struct(-F.col("members"), F.col("cluster_id"))).alias("keeper")
        )
        judged = proposing.join(kept, "wish", "left").withColumn(
            "refused", F.coalesce(F.col("keeper") != F.col("cluster_id"), F.lit(False))
        )
        state = cut_lineage(
            judged.select(
                "cluster_id", "members", "first_member", "wishes",
                (F.col("at") + F.col("refused").cast("int")).alias("at"), "refused",
            )
        )
        if state.filter("refused").isEmpty():
            break
    fresh = uuid_from_text(F.concat(F.lit(f"cluster|{run}"), F.col("first_member")))
    return state.select(F.coalesce(wish, fresh).alias("employer_id"), "cluster_id")


def _overlap(ids: DataFrame, old_clusters: DataFrame, new_clusters: DataFrame) -> DataFrame:
    """Shared members per (new cluster, old employer id)."""
    before = old_clusters.join(ids.hint("merge"), "cluster_id").select("unique_id", "employer_id")
    return (
        before.join(new_clusters.hint("merge"), "unique_id")
        .groupBy("cluster_id", "employer_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def retire_ids(
    previous_ids: DataFrame, previous_clusters: DataFrame, new_ids: DataFrame, clusters: DataFrame
) -> DataFrame:
    """(employer_id, cluster_id, superseded_by) of ids no longer in use: the id that took most of their members."""
    retired = previous_ids.select("employer_id", "cluster_id").join(
        new_ids.select("employer_id").distinct().hint("merge"), "employer_id", "left_anti"
    )
    taken = (
        previous_clusters.join(retired.hint("merge"), "cluster_id")
        .select("unique_id", F.col("employer_id").alias("old_id"))
        .join(clusters.hint("merge"), "unique_id")
        .join(new_ids.hint("merge"), "cluster_id")
        .groupBy("old_id", "employer_id")
        .agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("old_id")
        .agg(F.min_by("employer_id", F.struct(-F.col("shared"), F.col("employer_id"))).alias("superseded_by"))
    )
    return retired.join(taken, retired.employer_id == taken.old_id, "left").select(
        "employer_id", "cluster_id", "superseded_by"
    )
