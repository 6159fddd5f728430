"""A partition map that lives on: ids of k-mers are set, read, and given to groups of k-mers that are found together.

A map is (kmer, partition_id), a row a k-mer; id 0 stands for none, so rows of id 0 count as absent, and none is ever returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .graph import components
from .order import numbered


def get_ids(parts: DataFrame, kmers: DataFrame) -> DataFrame:
    """(kmer, partition_id) of the distinct kmers; 0 where the map has none."""
    own = parts.select("kmer", "partition_id")
    return kmers.select("kmer").distinct().join(own, "kmer", "left").select("kmer", F.coalesce("partition_id", F.lit(0)).alias("partition_id"))


def set_ids(parts: DataFrame, updates: DataFrame) -> DataFrame:
    """The map after updates (kmer, partition_id): they replace and add ids, and id 0 takes a k-mer out. Of several updates of
    a k-mer the highest id counts. One shuffle of both, summed up before it."""
    both = parts.select("kmer", "partition_id", F.lit(0).alias("later")).unionByName(updates.select("kmer", "partition_id", F.lit(1).alias("later")))
    last = both.groupBy("kmer").agg(F.max(F.struct("later", "partition_id"))["partition_id"].alias("partition_id"))
    return last.where("partition_id <> 0")


def assign(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """The map after each group (group_id, kmer) was made one partition with all others that it shares a k-mer with, groups and
    partitions alike. A partition keeps the least id that it had in the map; one that had none gets the next free id, in ascending order
    of its least group. The same as joining the groups one by one, but for the names. group_id: whole numbers from 0. A written table."""
    own = parts.where("partition_id <> 0").select("kmer", (F.col("partition_id") * 2).alias("node"))
    told = groups.select("kmer", (F.col("group_id") * 2 + 1).alias("node")).distinct()
    members = written(own.unionByName(told))
    hub = members.groupBy("kmer").agg(F.min("node").alias("other"))  # a star for each k-mer, so no pairs within a group
    links = members.join(hub, "kmer").where("node <> other").select(F.col("node").alias("kmer"), "other").distinct()
    nodes = members.select(F.col("node").alias("kmer")).distinct()
    joined = written(components(links, nodes).select(F.col("kmer").alias("node"), F.col("partition_id").alias("root")))
    had, group = F.when(F.col("node") % 2 == 0, F.floor(F.col("node") / 2)), F.when(F.col("node") % 2 == 1, F.floor(F.col("node") / 2))
    roots = joined.groupBy("root").agg(F.min(had).alias("id"), F.min(group).alias("first"))
    highest = own.agg(F.coalesce(F.max(F.floor(F.col("node") / 2)), F.lit(0)).alias("n")).first()["n"]
    fresh = numbered(roots.where("id IS NULL").select("root", "first"), ["first"], "place")
    name = roots.where("id IS NOT NULL").select("root", "id").unionByName(fresh.select("root", (F.col("place") + highest + 1).alias("id")))
    named = members.join(joined, "node").select("kmer", "root").distinct().join(name, "root")
    out = written(named.select("kmer", F.col("id").cast("long").alias("partition_id")))
    dropped(members, joined, fresh)
    return out
