"""Many breadth-first searches of the k-mer graph at once, each with its own limits.

A search is known by its source; all searches go a step further in a round, which joins the rows (source, k-mer) of the last round with the
neighbours of k-mers. A node's neighbours have it as theirs, so what a round finds was met in the two rounds before it or never, but
for tags, from which no search goes on: these are remembered. Limits are counts a source, kept in a table of one row a source; a search that has
reached its limit has no rows in the next round. No search is cut after the fact, so a round costs what the open searches find.

Neighbours are visited in the order right A, C, G, T, left A, C, G, T; this order decides what a search that is cut short has kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmers as K
from ..session import dropped, written
from .graph import components
from .order import numbered

WAVE = 1_000_000
BIG = 200  # fixed value: searches that visit more nodes than this count as big
TURN = (0, 2, 3, 1)  # A, C, G, T among the digits A, T, C, G


def adjacency(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, at, other): existing neighbours with their place in the order of visits. A written table."""
    both = nodes.select("kmer", K.reverse_number(F.col("kmer"), k).alias("r"))
    both = both.select("kmer", *(K.neighbours(F.col("kmer"), F.col("r"), k, side).alias(side) for side in ("right", "left")))
    every = F.array(*(F.element_at(side, t + 1) for side in ("right", "left") for t in TURN))
    near = both.select("kmer", F.posexplode(every).alias("at", "other"))
    return written(near.join(nodes.select(F.col("kmer").alias("other")), "other", "left_semi").select("kmer", "at", "other"))


def without_hubs(near: DataFrame, most: int = 4) -> DataFrame:
    """near without ways into nodes of more than so many neighbours."""
    hubs = near.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("kmer").alias("other"))
    return near.join(hubs, "other", "left_anti").select("kmer", "at", "other")


def search(near: DataFrame, starts: DataFrame, radius: int | None = None, stop: DataFrame | None = None, tags: DataFrame | None = None, most: int | None = None, then: str = "end", multi: bool = False) -> DataFrame:
    """(source, kmer, depth[, place]) of the nodes that searches visit. A written table.

    starts: (source, kmer), a row a source, or several with multi. stop: (kmer), never visited, or (kmer, since) with since not above source for
    the sources that avoid it. tags: (kmer), visited but not left, except where a search starts (with multi: there too). most: the
    number of nodes after which a search ends: then "end" lets it finish its round (its count is most or more), "exact" keeps
    the first most nodes in the order of visits, "clear" drops all rows of a search that visits more."""

    def allowed(rows: DataFrame) -> DataFrame:
        if stop is None:
            return rows
        if "since" not in stop.columns:
            return rows.join(stop.select("kmer").distinct(), "kmer", "left_anti").select(*rows.columns)
        s = stop.select(F.col("kmer").alias("__kmer"), "since")
        return rows.join(s, (F.col("kmer") == F.col("__kmer")) & (F.col("since") < F.col("source")), "left_anti").select(*rows.columns)

    is_tag = None if tags is None else tags.select("kmer").distinct().withColumn("tag", F.lit(True))

    def marked(rows: DataFrame, first: bool) -> DataFrame:
        if is_tag is None or (first and not multi):
            return rows.withColumn("tag", F.lit(False))
        return rows.join(is_tag, "kmer", "left").select(*rows.columns, F.coalesce("tag", F.lit(False)).alias("tag"))

    front = allowed(starts.select("source", "kmer").distinct()).withColumn("depth", F.lit(0)).withColumn("place", F.lit(0).cast("long"))
    front = written(marked(front, True))
    levels, totals, big, absorbed = [front], None, None, None
    depth = 0
    while radius is None or depth < radius:
        if most is not None:
            n = front.groupBy("source").agg(F.count("*").alias("n"))
            both = n if totals is None else totals.unionByName(n).groupBy("source").agg(F.sum("n").alias("n"))
            last, totals = totals, written(both)
            dropped(last)
        live = front.where("NOT tag").select("source", "kmer", "place")
        if most is not None:
            full = totals.where(F.col("n") > most if then == "clear" else F.col("n") >= most).select("source")
            live = live.join(full, "source", "left_anti")
        depth += 1
        met = live.join(near, "kmer").select("source", F.col("other").alias("kmer"), (F.col("place") * 8 + F.col("at")).alias("place"))
        met = allowed(met.groupBy("source", "kmer").agg(F.min("place").alias("place")))
        known = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])
        known = known.select("source", "kmer")
        if is_tag is not None:
            own = front.where("tag").select("source", "kmer")
            last, absorbed = absorbed, written(own if absorbed is None else absorbed.unionByName(own))
            dropped(last)
            known = known.unionByName(absorbed)
        met = met.join(known, ["source", "kmer"], "left_anti")
        if then == "exact" and most is not None:
            turn = F.row_number().over(Window.partitionBy("source").orderBy("place"))  # at most 8 * most rows a source
            met = met.withColumn("place", turn.cast("long")).join(totals, "source", "left").where(F.col("place") + F.coalesce("n", F.lit(0)) <= most)
        else:
            met = met.withColumn("place", F.lit(0).cast("long"))
        front = written(marked(met.select("source", "kmer", F.lit(depth).alias("depth"), "place"), False))
        if front.isEmpty():
            dropped(front)
            break
        levels.append(front)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    if most is not None and then == "clear":
        n = every.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > most)
        big = written(n.select("source"))
        every = every.join(big, "source", "left_anti")
    out = written(every.select("source", "kmer", "depth", "place", "tag"))
    dropped(*levels, totals, big, absorbed)
    return out


def connected_sizes(nodes: DataFrame, starts: DataFrame, k: int, threshold: int | None = None, stop: DataFrame | None = None, circumference: bool = False) -> DataFrame:
    """(source, size): nodes connected with each start (source, kmer), or threshold where there are as many; searches end when they have
    threshold nodes. circumference: nodes of more than four neighbours are not entered. Starts that do not exist have size 0."""
    near = adjacency(nodes, k)
    known = starts.select("source", "kmer").join(nodes.select("kmer"), "kmer", "left_semi")
    if threshold is None:
        n, used = _whole_sizes(nodes, near, known, stop, circumference), []
    else:
        ways = written(without_hubs(near)) if circumference else near
        found = search(ways, known, stop=stop, most=threshold)
        n, used = found.groupBy("source").agg(F.count("*").alias("n")), [found, *([ways] if circumference else [])]
    out = written(starts.select("source").distinct().join(n, "source", "left").select("source", F.least(F.coalesce("n", F.lit(0)), F.lit(threshold)).cast("long").alias("size")))
    dropped(near, *used)
    return out


def _whole_sizes(nodes: DataFrame, near: DataFrame, starts: DataFrame, stop: DataFrame | None, circumference: bool) -> DataFrame:
    """(source, n) of searches without limits, from the components of the nodes that may be entered: a start that may not
    be entered itself, for its many neighbours, reaches itself and the components of its neighbours."""
    open_ = nodes.select("kmer") if stop is None else nodes.select("kmer").join(stop.select("kmer"), "kmer", "left_anti")
    begun = starts.join(open_, "kmer", "left_semi")
    if circumference:
        open_ = open_.join(near.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 4"), "kmer", "left_anti")
    links = near.join(open_, "kmer", "left_semi").join(open_.select(F.col("kmer").alias("other")), "other", "left_semi")
    parts = written(components(links.select("kmer", "other"), open_))
    sizes = parts.groupBy("partition_id").agg(F.count("*").alias("n"))
    entered = begun.join(parts, "kmer").select("source", "partition_id")
    outside = begun.join(parts, "kmer", "left_anti")
    reached = outside.join(near, "kmer").select("source", F.col("other").alias("kmer")).join(parts, "kmer").select("source", "partition_id").distinct()
    met = entered.unionByName(reached).join(sizes, "partition_id").select("source", "n")
    return met.unionByName(outside.select("source", F.lit(1).cast("long").alias("n"))).groupBy("source").agg(F.sum("n").alias("n"))


def traverse(nodes: DataFrame, starts: DataFrame, k: int, radius: int, stop: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(source, kmer, depth) of the nodes within radius of each start; with most the first most + 1 in the order of visits."""
    near = adjacency(nodes, k)
    found = search(near, starts, radius, stop, most=None if most is None else most + 1, then="exact")
    dropped(near)
    return found.select("source", "kmer", "depth")


def find_tags(nodes: DataFrame, tags: DataFrame, k: int, density: int, stop: DataFrame | None = None, stop_big: bool = False, band: tuple[int, int] | None = None, big: int = BIG, starts: DataFrame | None = None) -> DataFrame:
    """(source, kmer): the tags that each tag finds within 2 * density + 1 steps on ways that pass no other tag and no stop tag.
    stop_big: a search that visits more than big nodes finds nothing. band: with nodes (kmer, count), only nodes whose count lies in it are visited. starts: (kmer), the tags that search (all where not given)."""
    if band:
        nodes = nodes.where(F.col("count").between(*band))
    near = adjacency(nodes.select("kmer"), k)
    starts = (tags if starts is None else starts).select(F.col("kmer").alias("source"), "kmer").distinct()
    if band:
        starts = starts.join(nodes.select("kmer"), "kmer", "left_semi")
    found = search(near, starts, 2 * density + 1, stop, tags, most=big if stop_big else None, then="clear")
    out = written(found.where("tag AND depth > 0").select("source", "kmer"))
    dropped(near, found)
    return out


def found_partitions(tags: DataFrame, links: DataFrame) -> DataFrame:
    """(kmer, partition_id) of all tags from what find_tags found: tags that find each other are one partition, named by the least."""
    return components(links.select(F.col("source").alias("kmer"), F.col("kmer").alias("other")), tags.select("kmer").distinct())


def traverse_from_tags(nodes: DataFrame, tags: DataFrame, counts: DataFrame, k: int, radius: int, threshold: int, frequency: int, stop: DataFrame | None = None, wave: int = WAVE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stop tags (kmer, since), counts (kmer, count) after it, tags of small searches): searches within radius from every tag, in ascending order. Those that visit threshold
    nodes count each of them once more, or make it a stop tag where its count is above frequency already; later searches avoid it.

    Successive tags are a wave. All of its searches run at once and avoid the stop tags of the waves before; what they visit holds all that they would
    visit one after the other. The nodes found, their neighbours and counts go to one task, which searches among them in order. The next wave has as
    many tags as promise about wave rows (source, k-mer), so no task is told more than about so many nodes."""
    near = adjacency(nodes.select("kmer"), k)
    starts = numbered(tags.select(F.col("kmer").alias("source"), "kmer").distinct(), ["source"], "turn")
    counted = counts.groupBy("kmer").agg(F.sum("count").cast("long").alias("count"))
    fixed, done, at, most = None if stop is None else stop.select("kmer"), [], 0, starts.count()
    span = max(1, wave // (1 + sum(8 * 7**i for i in range(radius))))  # a search visits no more

    def settle(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield _in_order(pa.Table.from_batches(held).combine_chunks(), radius, threshold, frequency)

    while at < most:
        avoid, so_far = fixed, None
        for d in done:
            so_far = d if so_far is None else so_far.unionByName(d)
        if so_far is not None:
            new = so_far.where("since IS NOT NULL").select("kmer")
            avoid = new if fixed is None else fixed.unionByName(new)
        balls = search(near, starts.where(F.col("turn").between(at, at + span - 1)).select("source", "kmer"), radius, avoid)
        own = balls.groupBy("kmer").agg((F.min("depth") == 0).alias("tag"))  # only a search's own tag has depth 0
        own = own.join(counted, "kmer", "left")
        if so_far is not None:
            own = own.join(so_far.groupBy("kmer").agg(F.sum("more").alias("more")), "kmer", "left").withColumn("count", F.coalesce("count", F.lit(0)) + F.coalesce("more", F.lit(0)))
        ways = near.join(balls.select("kmer").distinct(), "kmer", "left_semi").groupBy("kmer").agg(F.collect_list("other").alias("others"))
        told = own.join(ways, "kmer", "left").select("kmer", "tag", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("others", F.array().cast("array<long>")).alias("others"))
        done.append(written(told.repartition(1).mapInArrow(settle, "kmer long, more long, since long, large boolean")))
        rows = balls.count()
        dropped(balls)
        at += span
        span = max(1, min(8 * span, int(span * wave / max(1, rows))))
    every = done[0] if done else nodes.sparkSession.createDataFrame([], "kmer long, more long, since long, large boolean")
    for d in done[1:]:
        every = every.unionByName(d)
    new = written(every.where("since IS NOT NULL").select("kmer", "since"))
    more = every.where("more > 0").select("kmer", F.col("more").alias("count"))
    after = written(counts.select("kmer", F.col("count").cast("long").alias("count")).unionByName(more).groupBy("kmer").agg(F.sum("count").alias("count")))
    little = written(starts.select("kmer").join(every.where("large").select("kmer"), "kmer", "left_anti"))
    dropped(near, starts, *done)
    return new, after, little


def _in_order(told: pa.Table, radius: int, threshold: int, frequency: int) -> pa.RecordBatch:
    """(kmer, more, since, large) of a wave's nodes (kmer, tag, count, others) of which anything changed: searches from its tags one after the other."""
    told = told.sort_by("kmer").combine_chunks()
    kmer, count = (told.column(c).to_numpy() for c in ("kmer", "count"))
    others = told.column("others").combine_chunks()
    other, size = others.flatten().to_numpy(), np.diff(others.offsets.to_numpy())
    to = np.minimum(np.searchsorted(kmer, other), len(kmer) - 1)
    here = kmer[to] == other  # what no search of the wave visits is told of by no row
    size = np.bincount(np.repeat(np.arange(len(kmer)), size)[here], minlength=len(kmer))
    to, end = to[here], np.cumsum(size)
    seen, stopped = np.full(len(kmer), -1), np.zeros(len(kmer), bool)
    more, since, large = np.zeros(len(kmer), np.int64), np.full(len(kmer), -1), np.zeros(len(kmer), bool)
    for t in np.flatnonzero(told.column("tag").to_numpy()).tolist():
        if stopped[t]:
            continue
        front = np.array([t])
        seen[t], every = t, [front]
        for _ in range(radius):
            n = size[front]
            met = to[np.repeat(end[front] - np.cumsum(n), n) + np.arange(n.sum())]
            front = np.unique(met[(seen[met] != t) & ~stopped[met]])
            if not len(front):
                break
            seen[front] = t
            every.append(front)
        ball = np.concatenate(every)
        if len(ball) < threshold:
            continue
        full = count[ball] + more[ball] > frequency
        large[t], since[ball[full]], stopped[ball[full]] = True, kmer[t], True
        more[ball[~full]] += 1
    changed = np.flatnonzero((more > 0) | stopped | large)
    first = pa.array(since[changed], pa.int64(), mask=~stopped[changed])
    return pa.RecordBatch.from_arrays([pa.array(kmer[changed]), pa.array(more[changed]), first, pa.array(large[changed])], names=["kmer", "more", "since", "large"])


def repartition_largest(nodes: DataFrame, tags: DataFrame, parts: DataFrame, counts: DataFrame, k: int, density: int, radius: int, threshold: int, frequency: int, stop: DataFrame | None = None, small: DataFrame | None = None) -> dict[str, DataFrame]:
    """One attempt to split the largest partition of tags: searches from its tags choose stop tags, and its tags are partitioned anew without passing them;
    other partitions stay. parts: (kmer, partition_id). small: (kmer), tags whose searches are left out since they were small
    before. Returns parts, stop and small (those of before included) and the counts after it. Of the largest partitions the one of the higher id is taken."""
    size = parts.groupBy("partition_id").agg(F.count("*").alias("n"))
    first = size.orderBy(F.desc("n"), F.desc("partition_id")).limit(1).select("partition_id")
    own = written(parts.join(F.broadcast(first), "partition_id", "left_semi").select("kmer"))  # one row
    asked = own if small is None else own.join(small, "kmer", "left_anti")
    fresh, after, little = traverse_from_tags(nodes, asked, counts, k, radius, threshold, frequency, stop)
    every = fresh.select("kmer") if stop is None else fresh.select("kmer").unionByName(stop.select("kmer")).distinct()
    links = find_tags(nodes, tags, k, density, every, starts=own)
    among = links.join(own, "kmer", "left_semi").select("source", "kmer")
    split = found_partitions(own, among)
    rest = parts.join(own, "kmer", "left_anti").select("kmer", "partition_id")
    done = written(rest.unionByName(split.select("kmer", "partition_id")))
    return {"parts": done, "stop": written(every), "small": written(little if small is None else small.unionByName(little).distinct()), "counts": after}


def split_largest(nodes: DataFrame, tags: DataFrame, counts: DataFrame, k: int, density: int, radius: int, threshold: int, frequency: int, stop: DataFrame | None = None, rounds: int = 5) -> dict[str, DataFrame]:
    """Partitions the tags and tries to split the largest partition until it is smaller, no search is large any more, or rounds are over."""
    links = find_tags(nodes, tags, k, density, stop)
    now = {"parts": written(found_partitions(tags, links)), "stop": stop, "small": None, "counts": counts}
    most = lambda parts: parts.groupBy("partition_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    size = most(now["parts"])
    for _ in range(rounds if size else 0):
        before = 0 if now["small"] is None else now["small"].count()
        now = repartition_largest(nodes, tags, now["parts"], now["counts"], k, density, radius, threshold, frequency, now["stop"], now["small"])
        if most(now["parts"]) < size or now["small"].count() - before >= size:
            break
    return now


def sweep(nodes: DataFrame, kmers: DataFrame, tags: DataFrame, k: int, radius: int, stop: DataFrame | None = None, big: int | None = None) -> DataFrame:
    """(source, kmer): the tags within radius of any k-mer of a read. kmers: (source, kmer). Searches do not leave tags. big: reads whose search
    visits more than so many nodes find nothing."""
    near = adjacency(nodes.select("kmer"), k)
    if big is None:  # ways go both ways: the k-mers around each tag are found once, and reads meet them
        own = tags.select("kmer").distinct()
        found = search(near, own.select(F.col("kmer").alias("source"), "kmer"), radius, stop, own)
        ball = found.where("depth = 0 OR NOT tag").select("kmer", F.col("source").alias("tag"))  # a read's own tag is not left
        out = written(kmers.select("source", "kmer").join(ball, "kmer").select("source", F.col("tag").alias("kmer")).distinct())
    else:
        found = search(near, kmers.select("source", "kmer"), radius, stop, tags, most=big, then="clear", multi=True)
        out = written(found.where("tag").select("source", "kmer"))
    dropped(near, found)
    return out


def sweep_labels(swept: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, label), each once, of the tags that a sweep found. labels: (tag, label)."""
    return swept.join(labels.select(F.col("tag").alias("kmer"), "label").distinct(), "kmer").select("source", "label").distinct()
