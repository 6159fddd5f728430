"""Queries of tags, labels, searches, paths and alignments over prose as DNA, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aligner, counting, graph, partition_map, paths, tagging, traversal
from ..sources import sequences
from .queries import DNA_K, _cc, _dna, dna, dna_kmers, table

DENSITY, TAG_EVERY, NEAR, BIG, BAND, SIZE = 40, 97, 2, 60, (2, 40), 12


def _reads(s, d):
    return dna(s, d).select("doc_id", "sample", "sequence")


def _counts(s, d):
    """A written table: all that a query knows of k-mers comes from it."""
    return counting.kmer_totals(dna(s, d), DNA_K)


def _tags(counts):
    return counts.where(F.col("kmer") % TAG_EVERY == 0).select("kmer")


def _of_src1(s, d):
    return dna_kmers(s, d).where("sample = 'src1'").select("kmer").distinct()


def q_consumed_in_order(s, d):
    every = tagging.lined(_reads(s, d), ["doc_id"], DNA_K)
    new = tagging.new_kmers(every).select("read_no", F.size("new").cast("long").alias("n_new"))
    return every.join(new, "read_no", "left").select("doc_id", "read_no", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def q_consume_tags(s, d):
    """Without SQL, which cannot walk all reads in order: tested against a plain walk, as the three after it."""
    every = tagging.lined(_reads(s, d), ["doc_id"], DNA_K)
    events = tagging.consume_and_tag(every, DENSITY)
    n = events.groupBy("read_no").agg(F.count("*").alias("n_met"), F.count_if("new").alias("n_new"))
    return every.join(n, "read_no", "left").select("doc_id", F.coalesce("n_met", F.lit(0)).alias("n_met"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def q_consume_labels(s, d):
    events = tagging.consume_and_tag(tagging.lined(_reads(s, d), ["doc_id"], DNA_K), DENSITY)
    return tagging.read_labels(events).groupBy("tag").agg(F.count("*").alias("n_labels"), F.min("label").alias("first"), F.max("label").alias("last"))


def q_consume_with_stop_tags(s, d):
    every = tagging.lined(_reads(s, d), ["doc_id"], DNA_K)
    return tagging.path_partitions(tagging.consume_and_tag(every, DENSITY, _of_src1(s, d)))


def q_unique_paths(s, d):
    return paths.unique_paths(_reads(s, d), ["doc_id"], DNA_K, 30, 0.5)


def q_connected_sizes(s, d):
    nodes = _counts(s, d).select("kmer")
    starts = _tags(nodes).select(F.col("kmer").alias("source"), "kmer")
    return traversal.connected_sizes(nodes, starts, DNA_K, SIZE, nodes.where("kmer % 3 = 0 AND kmer % 97 <> 0"), circumference=True)


def q_traverse_radius(s, d):
    nodes = _counts(s, d).select("kmer")
    starts = _tags(nodes).select(F.col("kmer").alias("source"), "kmer")
    return traversal.traverse(nodes, starts, DNA_K, 3, nodes.where("kmer % 5 = 0 AND kmer % 97 <> 0"))


def q_find_tags_stop_big(s, d):
    nodes = _counts(s, d).select("kmer")
    return traversal.find_tags(nodes, _tags(nodes), DNA_K, NEAR, stop_big=True, big=BIG)


def q_find_tags_in_band(s, d):
    counts = _counts(s, d)
    return traversal.find_tags(counts, _tags(counts), DNA_K, NEAR, band=BAND)


def q_band_partitions(s, d):
    counts = _counts(s, d)
    tags = _tags(counts)
    return traversal.found_partitions(tags, traversal.find_tags(counts, tags, DNA_K, NEAR, band=BAND))


def q_traverse_from_tags(s, d):
    """Without SQL: each search depends on those before it. Tested against one search after the other."""
    counts = _counts(s, d)
    stop, after, small = traversal.traverse_from_tags(counts, _tags(counts), counts, DNA_K, 3, 12, 6)
    said = after.join(stop.select("kmer", "since"), "kmer", "left").join(small.withColumn("small", F.lit(True)), "kmer", "left")
    return said.select("kmer", "count", "since", F.coalesce("small", F.lit(False)).alias("small"))


def q_label_sweep(s, d):
    km = dna_kmers(s, d)
    labels = km.where(F.col("kmer") % TAG_EVERY == 0).select(F.col("kmer").alias("tag"), F.col("sample").alias("label")).distinct()
    nodes = _counts(s, d).select("kmer")
    swept = traversal.sweep(nodes, km.select(F.col("doc_id").alias("source"), "kmer"), _tags(nodes), DNA_K, 1)
    return traversal.sweep_labels(swept, labels).select(F.col("source").alias("doc_id"), "label")


def dealt_reads(s, d):
    """(doc_id, part, sequence): texts cut into reads of 60 bases, the last one of 15 to 74, so that only texts of fewer than 15 have none."""
    return dna(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("sequence", F.lit("([ACGT]{15,60}(?:[ACGT]{0,14}$)?)"))).alias("part", "sequence"))


def q_align_reads(s, d):
    """Without SQL: a search of ways. Tested against all ways. All bases of the texts, on the graph of all their k-mers."""
    got = aligner.align_reads(dealt_reads(s, d), counting.kmer_totals(dna(s, d), 15), ["doc_id", "part"], 15, 3)
    return got.withColumns({"score": F.round("score", 6), "counts": F.array_join("counts", ",")})


def q_paired_reads(s, d):
    """Turns of conversations as interleaved reads: questions are marked as first ones, answers as second ones."""
    mark = F.when(F.col("role") == "user", "/1").when(F.col("role") == "assistant", "/2").otherwise("")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), mark)
    reads = table(s, d, "conversations").select(F.lit("all").alias("sample"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("read_idx"), name.alias("name"), F.col("text").alias("sequence"), F.lit(None).cast("string").alias("quality"))
    return sequences.pairs(reads, "ignore").select("first.name", F.length("first.sequence").alias("n_first"), F.length("second.sequence").alias("n_second"), F.md5(F.concat("first.sequence", F.lit(" "), "second.sequence")).alias("digest"))


def q_component_sizes(s, d):
    """Partitions of a graph of k-mers that are neither single nor frequent, which falls into many components."""
    rare = _counts(s, d).where(F.col("count").between(*BAND))
    return graph.size_distribution(graph.partitions(rare.select("kmer"), DNA_K))


def q_component_coverage(s, d):
    rare = _counts(s, d).where(F.col("count").between(*BAND))
    return graph.mean_coverage(graph.partitions(rare.select("kmer"), DNA_K), rare)


def _graph(k: int) -> str:
    mask, top = (1 << 2 * k) - 1, 2 * (k - 1)
    return (
        _dna(k)
        + f""", nodes AS MATERIALIZED (SELECT kmer, any_value(least(f, r)) AS f, any_value(greatest(f, r)) AS r, count(*) AS n FROM words JOIN codes USING (w) GROUP BY kmer),
 near AS (SELECT kmer, least(((f << 2) & {mask}) | b, (r >> 2) | (xor(b, 1) << {top})) AS o FROM nodes, (SELECT CAST(unnest(range(4)) AS BIGINT) AS b)
  UNION ALL SELECT kmer, least((f >> 2) | (b << {top}), ((r << 2) & {mask}) | xor(b, 1)) FROM nodes, (SELECT CAST(unnest(range(4)) AS BIGINT) AS b)),
 links AS MATERIALIZED (SELECT kmer, o FROM near WHERE o IN (SELECT kmer FROM nodes))
"""
    )


G = _graph(DNA_K)


def _tag_walk(open_: str = "true") -> str:
    """Ways from tags that pass no other tag, through nodes that are open."""
    return (
        G
        + f""", free AS MATERIALIZED (SELECT DISTINCT l.kmer, l.o FROM links l JOIN nodes a ON a.kmer = l.kmer JOIN nodes z ON z.kmer = l.o WHERE {open_.format("a")} AND {open_.format("z")}),
 walk(source, kmer, depth) AS (SELECT kmer, kmer, 0 FROM nodes a WHERE kmer % {TAG_EVERY} = 0 AND {open_.format("a")}
  UNION SELECT w.source, l.o, depth + 1 FROM walk w JOIN free l ON l.kmer = w.kmer WHERE depth < {2 * NEAR + 1} AND (depth = 0 OR w.kmer % {TAG_EVERY} <> 0)),
 ball AS MATERIALIZED (SELECT source, kmer, min(depth) AS depth FROM walk GROUP BY ALL),
 met AS MATERIALIZED (SELECT source, kmer FROM ball WHERE depth > 0 AND kmer % {TAG_EVERY} = 0)
"""
    )


def q_assigned_partitions(s, d):
    """Partitions of tags that reads share: reads of one source first, then all others join them."""
    met = dna_kmers(s, d).where(F.col("kmer") % TAG_EVERY == 0).select("sample", F.col("doc_id").alias("group_id"), "kmer").distinct()
    none = met.limit(0).select("kmer", F.lit(0).cast("long").alias("partition_id"))
    return partition_map.assign(partition_map.assign(none, met.where("sample = 'src1'")), met.where("sample <> 'src1'"))


def q_updated_partitions(s, d):
    """A map of tags (the first read of each), whose tags in reads of one source get the last read's number, or go if that is 0."""
    met = dna_kmers(s, d).where(F.col("kmer") % TAG_EVERY == 0).select("sample", "doc_id", "kmer")
    parts = met.groupBy("kmer").agg((F.min("doc_id") + 1).alias("partition_id"))
    updates = met.where("sample = 'src1'").groupBy("kmer").agg((F.max("doc_id") % 5).alias("partition_id"))
    return partition_map.get_ids(partition_map.set_ids(parts, updates), met)


RARE = (
    G
    + f""", few AS MATERIALIZED (SELECT kmer, n FROM nodes WHERE n BETWEEN {BAND[0]} AND {BAND[1]}),
 twoway AS MATERIALIZED (SELECT DISTINCT kmer AS x, o AS y FROM links WHERE kmer IN (SELECT kmer FROM few) AND o IN (SELECT kmer FROM few))"""
    + _cc("SELECT kmer FROM few", "twoway")
    + ", parts AS MATERIALIZED (SELECT node AS kmer, label AS partition_id FROM cc) "
)
BANDED = "{}.n BETWEEN " + f"{BAND[0]} AND {BAND[1]}"
QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
SQL = {
    "consumed_in_order": _dna(DNA_K)
    + """, valid AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS read_no FROM (SELECT DISTINCT doc_id FROM km)),
 first AS (SELECT kmer, min(doc_id) AS doc_id FROM km GROUP BY kmer)
 SELECT v.doc_id, read_no, count(f.kmer) AS n_new FROM valid v LEFT JOIN first f USING (doc_id) GROUP BY ALL""",
    "unique_paths": _dna(DNA_K)
    + f""", first AS (SELECT kmer, min(doc_id) AS home FROM km GROUP BY kmer), flags AS (SELECT doc_id, pos, CASE WHEN home < doc_id THEN 1 ELSE 0 END AS seen FROM km JOIN first USING (kmer)),
 sized AS (SELECT doc_id, pos AS i, count(*) OVER (PARTITION BY doc_id) AS n, sum(seen) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {30 - DNA_K} FOLLOWING) AS c FROM flags),
 wins AS (SELECT doc_id, i, n, CAST(c AS REAL) / CAST({31 - DNA_K} AS REAL) <= CAST(0.5 AS REAL) AS ok FROM sized WHERE i <= n - {31 - DNA_K}),
 jumps AS MATERIALIZED (SELECT doc_id, i, n, min(CASE WHEN ok AND i < n - {31 - DNA_K} THEN i END) OVER later AS start, min(CASE WHEN NOT ok THEN i END) OVER later AS bad FROM wins
  WINDOW later AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 spans AS MATERIALIZED (SELECT j.doc_id, j.i, j.start, coalesce(t.bad - 2, t.n - {32 - DNA_K}) AS last FROM jumps j JOIN jumps t ON t.doc_id = j.doc_id AND t.i = j.start),
 found(doc_id, path, start, last) AS (SELECT doc_id, 0, start, last FROM spans WHERE i = 0
  UNION ALL SELECT f.doc_id, path + 1, s.start, s.last FROM found f JOIN spans s ON s.doc_id = f.doc_id AND s.i = f.last + {32 - DNA_K})
 SELECT doc_id, path, CAST(start AS INTEGER) AS start, CAST(least(last + 31 - start, length(seq) - start) AS INTEGER) AS length, substr(seq, CAST(start + 1 AS BIGINT), CAST(last + 31 - start AS BIGINT)) AS bases FROM found JOIN reads USING (doc_id)""",
    "connected_sizes": G
    + f""", hubs AS (SELECT kmer FROM links GROUP BY kmer HAVING count(*) > 4), enter AS MATERIALIZED (SELECT kmer FROM nodes WHERE NOT (kmer % 3 = 0 AND kmer % 97 <> 0) AND kmer NOT IN (SELECT kmer FROM hubs)),
 free AS MATERIALIZED (SELECT DISTINCT kmer AS x, o AS y FROM links WHERE kmer IN (SELECT kmer FROM enter) AND o IN (SELECT kmer FROM enter))"""
    + _cc("SELECT kmer FROM enter", "free")
    + f""", sizes AS MATERIALIZED (SELECT label, count(*) AS n FROM cc GROUP BY label), starts AS (SELECT kmer FROM nodes WHERE kmer % {TAG_EVERY} = 0),
 met AS (SELECT s.kmer, label FROM starts s JOIN cc ON node = s.kmer UNION SELECT s.kmer, label FROM starts s JOIN links l ON l.kmer = s.kmer JOIN cc ON node = l.o WHERE s.kmer NOT IN (SELECT kmer FROM enter)),
 reached AS (SELECT m.kmer, sum(n) AS n FROM met m JOIN sizes USING (label) GROUP BY m.kmer)
 SELECT s.kmer AS source, CAST(least(coalesce(n, 0) + CASE WHEN s.kmer IN (SELECT kmer FROM enter) THEN 0 ELSE 1 END, {SIZE}) AS BIGINT) AS size FROM starts s LEFT JOIN reached r ON r.kmer = s.kmer""",
    "traverse_radius": G
    + f""", free AS MATERIALIZED (SELECT DISTINCT kmer, o FROM links WHERE NOT (o % 5 = 0 AND o % 97 <> 0)),
 walk(source, kmer, depth) AS (SELECT kmer, kmer, 0 FROM nodes WHERE kmer % {TAG_EVERY} = 0 UNION SELECT w.source, l.o, depth + 1 FROM walk w JOIN free l ON l.kmer = w.kmer WHERE depth < 3)
 SELECT source, kmer, min(depth) AS depth FROM walk GROUP BY ALL""",
    "find_tags_stop_big": _tag_walk() + f", big AS (SELECT source FROM ball GROUP BY source HAVING count(*) > {BIG}) SELECT source, kmer FROM met WHERE source NOT IN (SELECT source FROM big)",
    "find_tags_in_band": _tag_walk(BANDED) + "SELECT source, kmer FROM met",
    "band_partitions": _tag_walk(BANDED) + ", both_ways AS MATERIALIZED (SELECT source AS x, kmer AS y FROM met UNION SELECT kmer, source FROM met)" + _cc(f"SELECT kmer FROM nodes WHERE kmer % {TAG_EVERY} = 0", "both_ways") + "SELECT node AS kmer, label AS partition_id FROM cc",
    "label_sweep": G
    + f""", own AS (SELECT DISTINCT doc_id, kmer FROM km), step AS (SELECT doc_id, kmer FROM own UNION SELECT doc_id, o FROM own JOIN links USING (kmer) WHERE kmer % {TAG_EVERY} <> 0)
 SELECT DISTINCT s.doc_id, e.sample AS label FROM step s JOIN exact e ON e.kmer = s.kmer WHERE s.kmer % {TAG_EVERY} = 0""",
    "paired_reads": """
WITH turns AS (SELECT conv_id, text, role, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations),
 runs AS (SELECT *, n - coalesce(max(CASE WHEN role <> 'user' THEN n END) OVER (ORDER BY n), 0) AS place, lead(conv_id) OVER (ORDER BY n) AS next_id, lead(role) OVER (ORDER BY n) AS next_role, lead(text) OVER (ORDER BY n) AS answer FROM turns)
 SELECT 'c' || conv_id || '/1' AS name, CAST(length(text) AS INTEGER) AS n_first, CAST(length(answer) AS INTEGER) AS n_second, md5(text || ' ' || answer) AS digest
 FROM runs WHERE role = 'user' AND place % 2 = 1 AND next_role = 'assistant' AND next_id = conv_id""",
    "assigned_partitions": _dna(DNA_K)
    + f""", met AS MATERIALIZED (SELECT DISTINCT sample = 'src1' AS early, doc_id, kmer FROM km WHERE kmer % {TAG_EVERY} = 0),
 hub AS (SELECT kmer, min(doc_id) AS h, min(CASE WHEN early THEN doc_id END) AS e FROM met GROUP BY kmer),
 twoway AS MATERIALIZED (SELECT doc_id AS x, h AS y FROM met JOIN hub USING (kmer) UNION SELECT h, doc_id FROM met JOIN hub USING (kmer)),
 before AS MATERIALIZED (SELECT doc_id AS x, e AS y FROM met JOIN hub USING (kmer) WHERE early UNION SELECT e, doc_id FROM met JOIN hub USING (kmer) WHERE early)"""
    + _cc("SELECT DISTINCT doc_id FROM met WHERE early", "before").replace("cc(node", "first(node").replace("FROM cc c", "FROM first c").replace("recurring.cc", "recurring.first")
    + _cc("SELECT DISTINCT doc_id FROM met", "twoway")
    + """, ids AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY label) AS id FROM first),
 had AS (SELECT label, min(id) AS id, min(cc.node) AS doc FROM cc LEFT JOIN ids ON ids.node = cc.node GROUP BY label),
 names AS (SELECT label, coalesce(id, (SELECT coalesce(max(id), 0) FROM ids) + count(*) FILTER (id IS NULL) OVER (ORDER BY doc)) AS id FROM had)
 SELECT DISTINCT kmer, CAST(id AS BIGINT) AS partition_id FROM met JOIN cc ON node = doc_id JOIN names USING (label)""",
    "updated_partitions": _dna(DNA_K)
    + f""", met AS MATERIALIZED (SELECT DISTINCT sample, doc_id, kmer FROM km WHERE kmer % {TAG_EVERY} = 0)
 SELECT kmer, coalesce(max(CASE WHEN sample = 'src1' THEN doc_id END) % 5, min(doc_id) + 1) AS partition_id FROM met GROUP BY kmer""",
    "component_sizes": RARE + "SELECT size, count(*) AS n_partitions FROM (SELECT count(*) AS size FROM parts GROUP BY partition_id) GROUP BY size",
    "component_coverage": RARE + "SELECT partition_id, CAST(floor(avg(n)) AS BIGINT) AS coverage FROM parts JOIN few USING (kmer) GROUP BY partition_id",
}
