"""The implicit de Bruijn graph: nodes are k-mers that occur, edges one-base shifts (k up to 31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kmers as K
from ..session import written


def edges(nodes: DataFrame, k: int, only: Column | None = None) -> DataFrame:
    """(kmer, side, other) of existing neighbours. nodes: (kmer), distinct canonical numbers. only: of kmer and other, edges that are wanted."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), K.neighbours(F.col("kmer"), F.col("r"), k, s).alias("to")) for s in ("left", "right")))
    both = nodes.select("kmer", K.reverse_number(F.col("kmer"), k).alias("r"))
    near = both.select("kmer", F.explode(sides).alias("s")).select("kmer", "s.side", F.explode("s.to").alias("other"))
    near = near if only is None else near.where(only)
    return near.join(nodes.select(F.col("kmer").alias("other")), "other", "left_semi").select("kmer", "side", "other")


def degree(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, degree): existing neighbours on both sides, 0 to 8."""
    n = edges(nodes, k).groupBy("kmer").agg(F.count("*").alias("n"))
    return nodes.join(n, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("degree"))


def reach(nodes: DataFrame, start: DataFrame, k: int, radius: int, stop: DataFrame | None = None) -> DataFrame:
    """(kmer, depth) of nodes within radius steps of start, never entering stop k-mers."""
    open_ = nodes if stop is None else nodes.join(stop.select("kmer"), "kmer", "left_anti")
    near = written(edges(open_, k).select("kmer", "other").distinct())
    seen = written(start.select("kmer").distinct().join(open_, "kmer", "left_semi").withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, radius + 1):
        front = written(front.join(near, "kmer").select(F.col("other").alias("kmer")).distinct().join(seen, "kmer", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kmer, partition_id): the least k-mer of the component. Each round every node with a smaller neighbour is merged into
    the least one of a chain of such, and links between merged nodes shrink by a factor, until none is left. The rounds' merges, each by that
    factor fewer than the ones before, are then followed from the last to the first."""
    left = written(links.select(F.greatest("kmer", "other").alias("a"), F.least("kmer", "other").alias("b")).where("a <> b").distinct())
    merges = []
    while not left.isEmpty():
        into = written(left.groupBy("a").agg(F.min("b").alias("m")))
        for _ in range(2):  # aims that are merged themselves: two doublings follow chains of four
            aim = into.select(F.col("a").alias("m"), F.col("m").alias("next"))
            into = into.join(aim, "m", "left").select("a", F.coalesce("next", "m").alias("m"))
        into = written(into)
        merges.append(into)
        to = lambda c: into.select(F.col("a").alias(c), F.col("m").alias(f"{c}_to"))  # noqa: E731, B023
        moved = left.join(to("a"), "a").join(to("b"), "b", "left").select(F.col("a_to").alias("x"), F.coalesce("b_to", "b").alias("y"))
        left = written(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    root = None
    for into in reversed(merges):  # an aim may be merged in several rounds: all of them lead to the least k-mer
        if root is None:
            root = into
        else:
            later = root.select(F.col("a").alias("m"), F.col("m").alias("last"))
            root = written(into.join(later, "m", "left").select("a", F.coalesce("last", "m").alias("m")).unionByName(root).distinct())
    if root is None:
        return nodes.select("kmer", F.col("kmer").alias("partition_id"))
    return nodes.join(root.select(F.col("a").alias("kmer"), "m"), "kmer", "left").select("kmer", F.coalesce("m", "kmer").alias("partition_id"))


def partitions(nodes: DataFrame, k: int) -> DataFrame:
    return components(edges(nodes, k, F.col("other") < F.col("kmer")), nodes)  # each edge is one of its lower end too


def partition_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("partition_id").agg(F.count("*").alias("size"))


def size_distribution(parts: DataFrame) -> DataFrame:
    return partition_sizes(parts).groupBy("size").agg(F.count("*").alias("n_partitions"))


def mean_coverage(parts: DataFrame, counts: DataFrame) -> DataFrame:
    return parts.join(counts, "kmer").groupBy("partition_id").agg(F.floor(F.avg("count")).cast("long").alias("coverage"))


def largest(parts: DataFrame) -> DataFrame:
    """The two largest partitions; of equal ones the higher id first."""
    return partition_sizes(parts).orderBy(F.desc("size"), F.desc("partition_id")).limit(2)


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(only_first, only_second, both): k-mers by membership."""
    a, b = first.select("kmer", F.lit(1).alias("x")), second.select("kmer", F.lit(1).alias("y"))
    both = a.join(b, "kmer", "full")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))


def read_partitions(kmers: DataFrame, parts: DataFrame, read: list[str]) -> DataFrame:
    """(read, partition_id, single): of the first k-mer with a partition, and whether the read has one at most."""
    met = kmers.join(parts, "kmer")
    return met.groupBy(*read).agg(F.min_by("partition_id", "pos").alias("partition_id"), (F.count_distinct("partition_id") <= 1).alias("single"))


def labels_of(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """(tag, labels) of linked labels, each once."""
    return tags.join(labels.distinct(), "tag").groupBy("tag").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def divide_tags(tags: DataFrame, every: int) -> DataFrame:
    """Every so many-th tag in ascending order, from the first. Ranks come from counts per range partition, not one task."""
    ranged = written(tags.select("kmer").distinct().repartitionByRange("kmer").sortWithinPartitions("kmer").withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    base, rows = 0, []
    for part, size in sizes:
        rows.append((part, base))
        base += size
    at = F.broadcast(tags.sparkSession.createDataFrame(rows, "part int, base long"))  # a row a partition
    return ranged.join(at, "part").where(F.pmod(F.col("base") + F.col("n"), F.lit(every)) == 0).select("kmer")


def connected_size(nodes: DataFrame, start: DataFrame, k: int, radius: int, threshold: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """One row: nodes within radius of start, truncated at threshold."""
    n = F.count("*")
    return reach(nodes, start, k, radius, stop).agg((n if threshold is None else F.least(n, F.lit(threshold))).alias("size"))


def trim_on_stop_tags(reads: DataFrame, kmers: DataFrame, stop: DataFrame, read: list[str], k: int) -> DataFrame:
    """(read, usable): place of a read's first stop-tag k-mer plus k - 2; all of it without one; 0 if it is not valid. reads:
    (read, sequence); kmers: (read, pos, kmer) of the valid ones."""
    first = kmers.join(stop.select("kmer").distinct(), "kmer", "left_semi").groupBy(*read).agg(F.min("pos").alias("at"))
    seq = K.normalise(F.col("sequence"))
    usable = F.when(~K.is_valid(seq, k), 0).when(F.col("at").isNotNull(), F.col("at") + k - 2).otherwise(F.length("sequence"))
    return reads.join(first, read, "left").select(*read, usable.cast("long").alias("usable"))


def stop_tag_positions(kmers: DataFrame, stop: DataFrame, read: list[str]) -> DataFrame:
    """(read, positions) of the stop-tag k-mers of reads that have any."""
    return kmers.join(stop.select("kmer").distinct(), "kmer", "left_semi").groupBy(*read).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def merge_partitions(first: DataFrame, second: DataFrame) -> DataFrame:
    """(kmer, partition_id) of two partition maps, in which partitions that share a k-mer are one, named by the least id of the first
    map where it has any, else of the second."""
    a, b = first.select("kmer", (F.col("partition_id") * 2).alias("x")), second.select("kmer", (F.col("partition_id") * 2 + 1).alias("y"))
    every = written(a.unionByName(b.select("kmer", F.col("y").alias("x"))))
    group = components(a.join(b, "kmer").select(F.col("x").alias("kmer"), F.col("y").alias("other")).distinct(), every.select(F.col("x").alias("kmer")).distinct()).select(F.col("kmer").alias("x"), "partition_id")
    return _named(every.join(group, "x"), F.struct((F.col("x") % 2).alias("second"), F.floor(F.col("x") / 2).alias("id")))


def join_by_path(parts: DataFrame, kmers: DataFrame, read: list[str]) -> DataFrame:
    """(kmer, partition_id) after all partitions that a read's k-mers meet are made one, named by the least id."""
    met = written(kmers.join(parts, "kmer").select(*read, "partition_id").distinct())
    links = met.join(met.groupBy(*read).agg(F.min("partition_id").alias("other")), read).select(F.col("partition_id").alias("kmer"), "other")
    group = components(links, parts.select(F.col("partition_id").alias("kmer")).distinct()).select(F.col("kmer").alias("partition_id"), F.col("partition_id").alias("to"))
    return parts.join(group, "partition_id").select("kmer", F.col("to").alias("partition_id"))


def _named(members: DataFrame, name) -> DataFrame:
    least = members.groupBy("partition_id").agg(F.min(name)["id"].alias("to"))
    return members.join(least, "partition_id").select("kmer", F.col("to").alias("partition_id")).distinct()


def partition_reads(reads: DataFrame, kmers: DataFrame, parts: DataFrame, read: list[str], k: int) -> DataFrame:
    """(read, partition_id, single) of all reads: null where no k-mer has a partition; single is false for reads that are not valid."""
    valid = K.is_valid(K.normalise(F.col("sequence")), k)
    return reads.join(read_partitions(kmers, parts, read), read, "left").select(*read, "partition_id", (valid & F.coalesce("single", F.lit(True))).alias("single"))


def tag_links(nodes: DataFrame, tags: DataFrame, k: int, density: int, stop: DataFrame | None = None) -> DataFrame:
    """(tag, found): tags met from each tag within 2 * density + 1 steps on paths that pass no other tag and no stop tag."""
    open_ = nodes if stop is None else nodes.join(stop.select("kmer"), "kmer", "left_anti")
    near = written(edges(open_, k).select("kmer", "other").distinct())
    own = written(tags.select("kmer").distinct().join(open_, "kmer", "left_semi"))
    front = seen = written(own.select(F.col("kmer").alias("tag"), "kmer"))
    found = None
    for _ in range(2 * density + 1):
        met = front.join(near, "kmer").select("tag", F.col("other").alias("kmer")).distinct()
        met = written(met.join(seen, ["tag", "kmer"], "left_anti").join(own.withColumn("is_tag", F.lit(True)), "kmer", "left"))
        hits = met.where("is_tag").select("tag", F.col("kmer").alias("found"))
        found = hits if found is None else found.unionByName(hits)
        if met.isEmpty():
            break
        front, seen = met.where("is_tag IS NULL").select("tag", "kmer"), seen.unionByName(met.select("tag", "kmer"))
    return found


def tag_partitions(nodes: DataFrame, tags: DataFrame, k: int, density: int, stop: DataFrame | None = None) -> DataFrame:
    """(kmer, partition_id) of the tags: those that find each other, directly or by others, are one partition, named by the least."""
    links = tag_links(nodes, tags, k, density, stop).select(F.col("tag").alias("kmer"), F.col("found").alias("other"))
    return components(links, tags.select("kmer").distinct())


def transfer_to_stop_tags(kmers: DataFrame, counts: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(stop tags, counts after): k-mers counted threshold times and more become stop tags, the others count once more.
    kmers: (kmer); counts: (kmer, count)."""
    held = kmers.select("kmer").distinct().join(counts, "kmer", "left").select("kmer", F.coalesce("count", F.lit(0)).alias("count"))
    more = held.where(F.col("count") < threshold).select("kmer", F.lit(1).alias("count"))
    return held.where(F.col("count") >= threshold).select("kmer"), counts.unionByName(more).groupBy("kmer").agg(F.sum("count").alias("count"))


def largest_split(parts: DataFrame) -> DataFrame:
    """(kmer, partition_id) of the largest partition, for another traversal of it; of equal ones the higher id."""
    first = largest(parts).orderBy(F.desc("size"), F.desc("partition_id")).limit(1).select("partition_id")
    return parts.join(F.broadcast(first), "partition_id", "left_semi").select("kmer", "partition_id")  # one row


def tag_lines(tags: DataFrame, k: int) -> DataFrame:
    """(kmer, value): tags as bases, to be written in ascending order of k-mers."""
    return tags.select("kmer").distinct().select("kmer", K.decode(F.col("kmer"), k).alias("value"))


def unassigned_reads(reads: DataFrame, kmers: DataFrame, parts: DataFrame, read: list[str]) -> DataFrame:
    """Names of reads none of whose k-mers has a partition, those that are not valid too."""
    met = kmers.join(parts.select("kmer").distinct(), "kmer", "left_semi").select(*read).distinct()
    return reads.select(*read).distinct().join(met, read, "left_anti")
