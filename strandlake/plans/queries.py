"""The comparison engine's queries over the driver's tables, and the same in SQL.

Two mappings stand in for sequencing data: baskets (sample = a supplier's nation, bin = a part key modulo a table size) and
prose as DNA (the letters A, C, G, T of each text, in order; sample = source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers as K
from ..operators import counting, graph, kernels, population, spectrum, stats
from ..session import small_batches, written

SIZES, DNA_K, DNA_SIZES = [1999, 2003], 11, [9973, 9967]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def basket(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("item"))
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.format_string("n%02d", "s_nationkey").alias("sample"))
    return counting.sketch(item.join(nation, "l_suppkey"), SIZES, key="item")


def dna(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    text = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, d, "documents").select(F.col("source").alias("sample"), "doc_id", text.alias("sequence"))


def dna_kmers(spark, d, k: int = DNA_K) -> DataFrame:
    return counting.explode_kmers(dna(spark, d), k)


def dna_totals(spark, d, k: int = DNA_K) -> DataFrame:
    """(kmer, count) of all texts, a written table."""
    return counting.kmer_totals(dna(spark, d), k)


def occurrences(spark, d) -> DataFrame:
    return counting.counted(dna_kmers(spark, d))


def _names(counts: DataFrame) -> list[str]:
    return kernels.sample_ids(counts)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names or ("value",)})


def q_kmer_count(s, d):
    return counting.exact_counts(dna_kmers(s, d))


def q_sketch_count(s, d):
    return counting.sketch(dna_kmers(s, d), DNA_SIZES).withColumn("count", F.col("count").cast("int"))


def q_consume_totals(s, d):
    return counting.consume_totals(dna(s, d), DNA_K)


def q_population(s, d):
    return population.population(basket(s, d))


def q_table_sums(s, d):
    return population.table_sums(basket(s, d))


def q_entropy_weights(s, d):
    c = basket(s, d)
    return _rounded(population.entropy_weights(c, len(_names(c))), "weight")


def q_sqrt_entropy_weights(s, d):
    c = basket(s, d)
    return _rounded(population.entropy_weights(c, len(_names(c)), root=True), "weight")


def q_kernel_unweighted(s, d):
    return _rounded(kernels.pairwise_kernel(basket(s, d), 2, "unweighted"))


def q_kernel_weighted(s, d):
    return _rounded(kernels.pairwise_kernel(basket(s, d), 2, "entropy"))


def q_kernel_weighted_gram(s, d):
    return _rounded(kernels.pairwise_kernel(basket(s, d), 2, "entropy", plan="gram"))


def q_kernel_weighted_given(s, d):
    c = basket(s, d)
    return _rounded(kernels.pairwise_kernel(c, 2, "entropy", weights=population.population(c).select("tab", "bin", (F.col("n_samples") % 4).cast("double").alias("weight"))))


def q_kernel_normalised(s, d):
    return _rounded(kernels.normalised(kernels.pairwise_kernel(basket(s, d), 2, "entropy")))


def q_distance_weighted(s, d):
    return _rounded(kernels.distance(kernels.pairwise_kernel(basket(s, d), 2, "entropy")))


def q_distance_unweighted(s, d):
    return _rounded(kernels.distance(kernels.pairwise_kernel(basket(s, d), 2, "unweighted")))


def q_distance_dna(s, d):
    c = written(counting.sketch(dna_kmers(s, d), DNA_SIZES))  # read by several joins
    return _rounded(kernels.distance(kernels.pairwise_kernel(c, 2, "entropy")))


def q_occupancy_rate(s, d):
    return _rounded(population.occupancy_rate(basket(s, d), SIZES), "rate")


def q_sample_stats(s, d):
    c = basket(s, d)
    return _rounded(stats.sample_stats(c, SIZES, len(_names(c))), "weighted_sum", "entropy")


def q_count_cap(s, d):
    return counting.cap(basket(s, d), 3).withColumn("count", F.col("count").cast("int"))


def q_occupied(s, d):
    return counting.occupied(basket(s, d))


def q_unique_kmers(s, d):
    return counting.unique_kmers(dna_kmers(s, d))


def q_approx_unique(s, d):
    return spectrum.approx_unique(dna_kmers(s, d))


def q_abundance_distribution(s, d):
    km = dna_kmers(s, d).select(F.lit("all").alias("sample"), "kmer")
    return spectrum.abundance_distribution(counting.exact_counts(km))


def q_counts_by_every_position(s, d):
    return spectrum.counts_by_position(occurrences(s, d), equal=1)


def q_read_median(s, d):
    return _rounded(spectrum.read_median(occurrences(s, d), ["doc_id"]), "mean", "stddev")


def q_read_extremes(s, d):
    return spectrum.read_extremes(occurrences(s, d), ["doc_id"])


def q_median_at_least(s, d):
    return spectrum.median_at_least(occurrences(s, d), ["doc_id"], 3)


def q_trim_low(s, d):
    return spectrum.trim_length(occurrences(s, d), ["doc_id"], DNA_K, least=2)


def q_trim_high(s, d):
    return spectrum.trim_length(occurrences(s, d), ["doc_id"], DNA_K, most=20)


def q_error_positions(s, d):
    return spectrum.error_positions(occurrences(s, d), ["doc_id"], DNA_K, 1).select("doc_id", F.size("positions").cast("long").alias("n"), F.coalesce(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("total"))


def q_sketch_lookup(s, d):
    km = written(counting.exact_counts(dna_kmers(s, d)))
    return counting.lookup(km.select("sample", "kmer"), counting.sketch(km, DNA_SIZES, weight=F.col("count")), DNA_SIZES)


def q_filter_present(s, d):
    reads = dna(s, d)
    return spectrum.reads_not_meeting(reads, DNA_K, counting.kmer_totals(reads.where("sample = 'src0'"), DNA_K), ["doc_id"])


def q_revcomp_decode_all(s, d):
    """The canonical strand is the k-mer or its reverse complement, as the numbers tell."""
    seq = F.col("sequence")
    h = dna(s, d).select("doc_id", seq.cast("binary").alias("bases"), K.kmer_hashes(seq, DNA_K, False).alias("f"), K.kmer_hashes(seq, DNA_K).alias("u"))
    w = F.substring("bases", F.col("pos") + 1, F.lit(DNA_K)).cast("string")  # bytes, whose places are found at once
    words = h.select("doc_id", "bases", "u", F.posexplode("f").alias("pos", "forward")).select("doc_id", "pos", w.alias("w"), "forward", F.get("u", F.col("pos")).alias("number"))
    both = words.withColumn("revcomp", K.reverse_complement(F.col("w")))
    return both.select("doc_id", "pos", "revcomp", F.when(F.col("forward") == F.col("number"), F.col("w")).otherwise(F.col("revcomp")).alias("canonical"), "forward")


def q_read_validate(s, d):
    raw = table(s, d, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    seq = K.normalise(F.col("w"))
    return raw.groupBy("doc_id").agg(F.count_if(K.is_valid(seq, 3)).alias("n_valid"), F.count("*").alias("n_words"))


def q_graph_degree(s, d):
    nodes = dna_totals(s, d, 9).select("kmer")
    return graph.degree(nodes, 9)


def q_partition_sizes(s, d):
    nodes = dna_totals(s, d, 15).select("kmer")
    return graph.partition_sizes(graph.partitions(nodes, 15))


GRAPH_K = 9


def _nodes(s, d, k: int = GRAPH_K) -> DataFrame:
    return dna_totals(s, d, k).select("kmer")


def q_position_lines(s, d):
    return spectrum.position_counts(occurrences(s, d), ["doc_id"])


def q_by_abundance(s, d):
    return spectrum.by_abundance(counting.exact_counts(dna_kmers(s, d)), 1)


def q_high_abundance(s, d):
    return spectrum.high_abundance(dna_kmers(s, d).withColumnRenamed("doc_id", "read_idx"), 2, 50)


def q_present_kmers(s, d):
    km = dna_kmers(s, d).select("sample", "kmer").distinct()
    return counting.present(km, km.where("sample = 'src0'"))


def q_kmer_strands(s, d):
    words = dna(s, d).select(F.explode(K.kmers(F.col("sequence"), DNA_K)).alias("w")).distinct()
    return words.select("w", K.build_kmer(F.col("w"), DNA_K).alias("x")).select("w", "x.f", "x.r", "x.u")


def q_kmer_arrays(s, d):
    h = dna(s, d).where(F.length("sequence") >= DNA_K).select("doc_id", *(K.kmer_hashes(F.col("sequence"), DNA_K, c).alias(n) for c, n in ((True, "u"), (False, "f"))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return h.select("doc_id", F.size("u").cast("long").alias("n"), total("u").alias("total"), total("f").alias("forward"))


def q_n_as_a(s, d):
    raw = table(s, d, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    return raw.groupBy("doc_id").agg(F.count_if(K.is_valid(K.normalise(F.col("w"), n_as_a=True), 3)).alias("n_valid"))


def q_sketch_unique(s, d):
    return counting.sketch_unique(dna_kmers(s, d), DNA_SIZES, ["doc_id", "pos"])


def q_big_counts(s, d):
    return counting.big_counts(dna_kmers(s, d, 5), [499, 503], ["doc_id", "pos"])


def q_presence_union(s, d):
    return counting.presence_union(counting.sketch(dna_kmers(s, d), DNA_SIZES))


def q_approx_unique_band(s, d):
    km = dna_kmers(s, d)
    got = spectrum.approx_unique(km).withColumnRenamed("n_unique", "approx").join(counting.unique_kmers(km), "sample")
    return got.select("sample", "n_unique", (F.abs(F.col("approx") - F.col("n_unique")) <= 0.1 * F.col("n_unique")).alias("near"))


def q_cardinality_union(s, d):
    km = dna_kmers(s, d)
    whole = spectrum.cardinality_sketch(km).withColumn("sample", F.lit("all"))
    one = spectrum.sketch_estimate(spectrum.union_sketches(whole, "sample")).withColumnRenamed("n_unique", "approx")
    exact = km.select(F.lit("all").alias("sample"), "kmer").groupBy("sample").agg(F.count_distinct("kmer").alias("n_unique"))
    return exact.join(one, "sample").select("n_unique", (F.abs(F.col("approx") - F.col("n_unique")) <= 0.1 * F.col("n_unique")).alias("near"))


def q_sample_names(s, d):
    ends = F.array(*(F.lit(x) for x in (".kh", ".ct.gz", ".cg", ".countgraph", ".x.y")))
    path = F.concat(F.lit("/data/run.1/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(s, d, "documents").select("doc_id", K.sample_name(path).alias("name"), K.stats_name(path).alias("short"))


def q_name_partitions(s, d):
    name = F.concat(F.lit("read "), F.col("doc_id").cast("string"), F.lit("\t"), (F.col("doc_id") % 7).cast("string"))
    return table(s, d, "documents").select("doc_id", K.partition_of_name(name).alias("part"))


def q_valid_pairs(s, d):
    i, j = F.col("doc_id").cast("string"), (F.col("doc_id") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("string")
    slash = K.valid_pair(F.concat(F.lit("r"), i, F.lit("/1")), F.concat(F.lit("r"), j, F.lit("/2")))
    word = K.valid_pair(F.concat(F.lit("r"), i, F.lit(" 1:N:0:ACG")), F.concat(F.lit("r"), j, F.lit(" 2:Y:0:ACG x")))
    wrong = K.valid_pair(F.concat(F.lit("r"), i, F.lit("/2")), F.concat(F.lit("r"), i, F.lit("/1")))
    return table(s, d, "documents").select("doc_id", slash.alias("slash"), word.alias("word"), wrong.alias("wrong"))


def q_graph_reach(s, d):
    n = _nodes(s, d)
    return graph.reach(n, n.where("kmer < 500"), GRAPH_K, 3)


def q_connected_size(s, d):
    n = _nodes(s, d)
    return graph.connected_size(n, n.where("kmer < 5"), GRAPH_K, 2, threshold=1000, stop=n.where("kmer % 3 = 0 AND kmer >= 5"))


def q_partition_components(s, d):
    return graph.partitions(_nodes(s, d), GRAPH_K)


def q_partition_distribution(s, d):
    return graph.size_distribution(graph.partitions(_nodes(s, d), GRAPH_K))


def q_partition_coverage(s, d):
    c = dna_totals(s, d, GRAPH_K)
    return graph.mean_coverage(graph.partitions(c.select("kmer"), GRAPH_K), c)


def q_largest_partitions(s, d):
    return graph.largest(graph.partitions(_nodes(s, d), GRAPH_K))


def _by_remainder(s, d) -> DataFrame:
    """A partition map of all k-mers by their remainder, for operators on maps."""
    return _nodes(s, d).select("kmer", (F.col("kmer") % 5003).alias("partition_id"))


def q_read_partitions(s, d):
    got = graph.partition_reads(dna(s, d).select("doc_id", "sequence"), dna_kmers(s, d, GRAPH_K), _by_remainder(s, d).where("partition_id < 20"), ["doc_id"], GRAPH_K)
    return got.withColumn("partition_id", F.coalesce("partition_id", F.lit(-1).cast("long")))


def q_join_by_path(s, d):
    return graph.join_by_path(_by_remainder(s, d), dna_kmers(s, d, GRAPH_K), ["doc_id"])


def q_merge_partitions(s, d):
    n = _nodes(s, d)
    return graph.merge_partitions(n.where("kmer % 2 = 0").select("kmer", (F.col("kmer") % 5003).alias("partition_id")), n.where("kmer % 3 = 0").select("kmer", (F.col("kmer") % 7001).alias("partition_id")))


def q_compare_sets(s, d):
    km = dna_kmers(s, d)
    return graph.compare(km.where("sample = 'src0'").select("kmer").distinct(), km.where("sample <> 'src0'").select("kmer").distinct())


def q_divide_tags(s, d):
    return graph.divide_tags(_nodes(s, d), 10)


def q_tag_labels(s, d):
    km = dna_kmers(s, d, GRAPH_K).select(F.col("kmer").alias("tag"), F.col("sample").alias("label")).distinct()
    return graph.labels_of(km.select("tag").distinct(), km).select("tag", F.array_join("labels", ",").alias("labels"))


def q_trim_on_stop_tags(s, d):
    km = dna_kmers(s, d)
    return graph.trim_on_stop_tags(dna(s, d).select("doc_id", "sequence"), km, km.where("sample = 'src1'"), ["doc_id"], DNA_K)


def q_stop_tag_positions(s, d):
    km = dna_kmers(s, d)
    got = graph.stop_tag_positions(km, km.where("sample = 'src1'"), ["doc_id"])
    return got.select("doc_id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"))

def _tags(s, d) -> DataFrame:
    return _nodes(s, d).where("kmer % 97 = 0")


def q_tag_links(s, d):
    return graph.tag_links(_nodes(s, d), _tags(s, d), GRAPH_K, 1)


def q_tag_partitions(s, d):
    return graph.tag_partitions(_nodes(s, d), _tags(s, d), GRAPH_K, 1)


def q_transfer_to_stop_tags(s, d):
    counts = dna_kmers(s, d).groupBy("kmer").agg(F.count("*").alias("count"))
    stop, left = graph.transfer_to_stop_tags(counts.where("kmer % 2 = 0"), counts, 5)
    return left.join(stop.withColumn("stop", F.lit(True)), "kmer", "left").select("kmer", "count", F.coalesce("stop", F.lit(False)).alias("stop"))


def q_largest_split(s, d):
    return graph.largest_split(_by_remainder(s, d))


def q_tag_lines(s, d):
    return graph.tag_lines(_tags(s, d), GRAPH_K)


def q_unassigned_reads(s, d):
    reads = dna(s, d)
    met = spectrum.reads_meeting(reads, DNA_K, counting.kmer_totals(reads.where("sample = 'src0'"), DNA_K), ["doc_id"])
    return reads.select("doc_id").distinct().join(met, "doc_id", "left_anti")


def q_murmur_registers(s, d):
    """Without SQL, which has no such hash: tested against plain code."""
    words = dna(s, d).select("sample", F.explode(K.kmers(F.col("sequence"), DNA_K)).alias("w")).distinct()
    p = spectrum.precision(0.02)
    return spectrum.register_estimate(spectrum.registers(words.select("sample", K.murmur_hash(F.col("w")).alias("h")), p, "sample"), p, "sample")


BASKET = """
WITH hits AS (SELECT printf('n%02d', s_nationkey) AS sample, l_partkey AS item FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
counts AS (SELECT sample, 0 AS tab, item % 1999 AS bin, CAST(least(count(*), 255) AS BIGINT) AS "count" FROM hits GROUP BY ALL
 UNION ALL SELECT sample, 1, item % 2003, CAST(least(count(*), 255) AS BIGINT) FROM hits GROUP BY ALL),
"""
POPULATION = """
names AS (SELECT DISTINCT sample FROM counts), total AS (SELECT count(*) AS n FROM names),
pop AS (SELECT tab, bin, count(*) AS n_samples, CAST(sum("count") AS BIGINT) AS total FROM counts GROUP BY ALL),
ent AS (SELECT tab, bin, n_samples, CASE WHEN n_samples < n THEN -(n_samples/n)*log2(n_samples/n)-(1-n_samples/n)*log2(1-n_samples/n) ELSE 0 END AS w
 FROM (SELECT pop.*, CAST(n AS DOUBLE) AS n FROM pop, total))
"""


BASKET += POPULATION


def _kernel(weight: str, base: str = BASKET) -> str:
    return (
        base
        + f""", dots AS (SELECT x.sample AS a, y.sample AS b, x.tab AS tab, e.n_samples AS pc, any_value({weight}) AS w, CAST(sum(x."count" * y."count") AS BIGINT) AS dot
 FROM counts x JOIN counts y ON x.tab = y.tab AND x.bin = y.bin AND x.sample <= y.sample JOIN ent e ON e.tab = x.tab AND e.bin = x.bin GROUP BY x.sample, y.sample, x.tab, e.n_samples),
tabs AS (SELECT x.sample AS a, y.sample AS b, tab FROM names x, names y, (VALUES (0), (1)) t(tab) WHERE x.sample <= y.sample),
k AS (SELECT a, b, min(v) AS value FROM (SELECT t.a, t.b, t.tab, coalesce(sum(dot * w), 0) AS v FROM tabs t LEFT JOIN dots d ON d.a = t.a AND d.b = t.b AND d.tab = t.tab GROUP BY ALL) GROUP BY a, b),
diag AS (SELECT a AS s, value AS v FROM k WHERE a = b),
norm AS (SELECT k.a, k.b, CASE WHEN p.v * q.v > 0 THEN k.value / sqrt(p.v * q.v) ELSE 0 END AS value FROM k JOIN diag p ON p.s = k.a JOIN diag q ON q.s = k.b),
nd AS (SELECT a AS s, value AS v FROM norm WHERE a = b),
dist AS (SELECT n.a, n.b, CASE WHEN n.a <> n.b AND p.v > 0 AND q.v > 0 AND p.v + q.v - 2 * n.value > 0 THEN sqrt(p.v + q.v - 2 * n.value) ELSE 0 END AS value FROM norm n JOIN nd p ON p.s = n.a JOIN nd q ON q.s = n.b)
"""
    )


def _dna(k: int) -> str:
    number = lambda x: f"CAST(list_sum(list_transform(range(0, {k}), lambda i: (instr('ATCG', substr({x}, {k} - i, 1)) - 1) * CAST(pow(4, i) AS BIGINT))) AS BIGINT)"
    return f"""
WITH RECURSIVE reads AS (SELECT source AS sample, doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
words AS (SELECT sample, doc_id, pos - 1 AS pos, substr(seq, pos, {k}) AS w FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM reads WHERE length(seq) >= {k})),
codes AS (SELECT w, least({number("w")}, {number("reverse(translate(w, 'ATCG', 'TAGC'))")}) AS kmer, {number("w")} AS f, {number("reverse(translate(w, 'ATCG', 'TAGC'))")} AS r FROM (SELECT DISTINCT w FROM words)),
km AS (SELECT sample, doc_id, pos, kmer FROM words JOIN codes USING (w)),
exact AS MATERIALIZED (SELECT sample, kmer, count(*) AS "count" FROM km GROUP BY ALL),
occ AS (SELECT km.*, "count" FROM km JOIN exact USING (sample, kmer)),
bins AS (SELECT sample, 0 AS tab, kmer % 9973 AS bin, CAST(least(sum("count"), 255) AS BIGINT) AS "count" FROM exact GROUP BY sample, kmer % 9973
 UNION ALL SELECT sample, 1, kmer % 9967, CAST(least(sum("count"), 255) AS BIGINT) FROM exact GROUP BY sample, kmer % 9967)
"""


GRAPH = (
    _dna(GRAPH_K)
    + """, nodes AS MATERIALIZED (SELECT DISTINCT kmer, least(f, r) AS f, greatest(f, r) AS r FROM codes),
 near AS (SELECT kmer, least(((f << 2) & 262143) | b, (r >> 2) | (xor(b, 1) << 16)) AS o FROM nodes, (SELECT CAST(unnest(range(4)) AS BIGINT) AS b)
  UNION ALL SELECT kmer, least((f >> 2) | (b << 16), ((r << 2) & 262143) | xor(b, 1)) FROM nodes, (SELECT CAST(unnest(range(4)) AS BIGINT) AS b)),
 links AS MATERIALIZED (SELECT kmer, o FROM near WHERE o IN (SELECT kmer FROM nodes))
"""
)


def _cc(nodes: str, links: str) -> str:
    """Labels that sink along links (x, y) until none is left to sink: cc (node, label)."""
    return f""", cc(node, label) USING KEY (node) AS (SELECT p, p FROM ({nodes}) t(p)
  UNION SELECT l.x, min(c.label) FROM cc c JOIN {links} l ON l.y = c.node JOIN recurring.cc r ON r.node = l.x WHERE c.label < r.label GROUP BY l.x)
"""


D, W = _dna(DNA_K), _kernel("e.w")
WALK = (
    GRAPH
    + """, walk(tag, kmer, depth) AS (SELECT kmer, kmer, 0 FROM nodes WHERE kmer % 97 = 0
  UNION SELECT w.tag, l.o, depth + 1 FROM walk w JOIN links l ON l.kmer = w.kmer WHERE depth < 3 AND (depth = 0 OR w.kmer % 97 <> 0)),
 met AS MATERIALIZED (SELECT DISTINCT tag AS x, kmer AS y FROM walk WHERE kmer % 97 = 0 AND kmer <> tag)
"""
)
CC = GRAPH + ", twoway AS MATERIALIZED (SELECT DISTINCT kmer AS x, o AS y FROM links)" + _cc("SELECT kmer FROM nodes", "twoway") + ", parts AS (SELECT node AS kmer, label AS partition_id FROM cc) "
R = "round(value, 6) + 0.0 AS value"
QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
SQL = {
    "kmer_count": D + "SELECT * FROM exact",
    "sketch_count": D + "SELECT * FROM bins",
    "consume_totals": D + f"SELECT sample, count(*) AS n_reads, CAST(sum(greatest(length(seq) - {DNA_K - 1}, 0)) AS BIGINT) AS n_kmers FROM reads GROUP BY sample",
    "population": BASKET + "SELECT * FROM pop",
    "table_sums": BASKET + "SELECT tab, CAST(sum(\"count\") AS BIGINT) AS total FROM counts GROUP BY tab",
    "entropy_weights": BASKET + "SELECT tab, bin, round(w, 6) + 0.0 AS weight FROM ent, total WHERE n_samples < n",
    "sqrt_entropy_weights": BASKET + "SELECT tab, bin, round(sqrt(w), 6) + 0.0 AS weight FROM ent, total WHERE n_samples < n",
    "kernel_unweighted": _kernel("1") + f"SELECT a, b, {R} FROM (SELECT a, b, CAST(value AS DOUBLE) AS value FROM k)",
    "kernel_weighted": W + f"SELECT a, b, {R} FROM k",
    "kernel_weighted_gram": W + f"SELECT a, b, {R} FROM k",
    "kernel_weighted_given": _kernel("CAST(e.n_samples % 4 AS DOUBLE)") + f"SELECT a, b, {R} FROM k",
    "kernel_normalised": W + f"SELECT a, b, {R} FROM norm",
    "distance_weighted": W + f"SELECT a, b, {R} FROM dist",
    "distance_unweighted": _kernel("1") + f"SELECT a, b, {R} FROM dist",
    "distance_dna": _kernel("e.w", D + ", counts AS MATERIALIZED (SELECT * FROM bins), " + POPULATION) + f"SELECT a, b, {R} FROM dist",
    "occupancy_rate": BASKET + "SELECT round(product(n / CASE WHEN tab = 0 THEN 1999.0 ELSE 2003.0 END), 6) + 0.0 AS rate FROM (SELECT tab, CAST(count(*) AS DOUBLE) AS n FROM pop GROUP BY tab)",
    "sample_stats": BASKET
    + """, h AS (SELECT sample, "count" AS c, count(*) AS n FROM counts WHERE tab = 0 GROUP BY ALL UNION ALL SELECT sample, 0, 1999 - count(*) FROM counts WHERE tab = 0 GROUP BY sample),
 e AS (SELECT sample, sum(-(n / 1999.0) * log2(n / 1999.0)) AS entropy FROM h WHERE n > 0 GROUP BY sample),
 v AS (SELECT sample, min(v) AS w FROM (SELECT c.sample, c.tab, sum(c."count" * sqrt(e.w)) AS v FROM counts c JOIN ent e USING (tab, bin) GROUP BY ALL) GROUP BY sample)
 SELECT s.sample, CAST(sum("count") AS BIGINT) AS sample_sum, round(any_value(v.w), 6) + 0.0 AS weighted_sum, round(any_value(e.entropy), 6) + 0.0 AS entropy
 FROM counts s JOIN e ON e.sample = s.sample JOIN v ON v.sample = s.sample WHERE tab = 0 GROUP BY s.sample""",
    "count_cap": BASKET + "SELECT sample, tab, bin, least(\"count\", 3) AS \"count\" FROM counts",
    "occupied": BASKET + "SELECT sample, count(*) AS occupied FROM counts WHERE tab = 0 GROUP BY sample",
    "unique_kmers": D + "SELECT sample, count(*) AS n_unique FROM exact GROUP BY sample",
    "abundance_distribution": D + "SELECT CAST(least(c, 65535) AS INTEGER) AS abundance, count(*) AS n_kmers FROM (SELECT kmer, sum(\"count\") AS c FROM exact GROUP BY kmer) GROUP BY 1",
    "read_median": D + "SELECT doc_id, list_sort(list(\"count\"))[len(list(\"count\")) // 2 + 1] AS median, round(avg(\"count\"), 6) + 0.0 AS mean, round(stddev_pop(\"count\"), 6) + 0.0 AS stddev FROM occ GROUP BY doc_id",
    "read_extremes": D + "SELECT doc_id, least(min(\"count\"), 255) AS min_count, max(\"count\") AS max_count FROM occ GROUP BY doc_id",
    "median_at_least": D + "SELECT doc_id, count(*) FILTER (\"count\" >= 3) >= floor(0.5 + count(*) / 2.0) AS enough FROM occ GROUP BY doc_id",
    "trim_low": D + f"SELECT doc_id, CASE WHEN n = 1 OR bad = 0 THEN 0 WHEN bad IS NULL THEN n + {DNA_K - 1} ELSE bad + {DNA_K - 1} END AS usable FROM (SELECT doc_id, count(*) AS n, min(pos) FILTER (\"count\" < 2) AS bad FROM occ GROUP BY doc_id)",
    "trim_high": D + f"SELECT doc_id, CASE WHEN n = 1 OR bad = 0 THEN 0 WHEN bad IS NULL THEN n + {DNA_K - 1} ELSE bad + {DNA_K - 1} END AS usable FROM (SELECT doc_id, count(*) AS n, min(pos) FILTER (\"count\" > 20) AS bad FROM occ GROUP BY doc_id)",
    "error_positions": D
    + f""", t AS (SELECT *, "count" > 1 AS ok, lag("count" > 1) OVER (PARTITION BY doc_id ORDER BY pos) AS before, min(pos) FILTER ("count" > 1) OVER (PARTITION BY doc_id) AS first FROM occ),
 p AS (SELECT doc_id, CASE WHEN pos = first AND pos > 0 THEN pos - 1 WHEN NOT ok AND before THEN pos + {DNA_K - 1} END AS place FROM t)
 SELECT doc_id, count(place) AS n, CAST(coalesce(sum(place), 0) AS BIGINT) AS total FROM p GROUP BY doc_id""",
    "sketch_lookup": D + "SELECT sample, kmer, least(sum(\"count\") OVER (PARTITION BY sample, kmer % 9973), sum(\"count\") OVER (PARTITION BY sample, kmer % 9967), 255)::INTEGER AS \"count\" FROM exact",
    "filter_present": D + "SELECT DISTINCT doc_id FROM km WHERE doc_id NOT IN (SELECT doc_id FROM km WHERE kmer IN (SELECT kmer FROM km WHERE sample = 'src0'))",
    "read_validate": "SELECT doc_id, count(*) FILTER (length(w) >= 3 AND regexp_full_match(upper(w), '[ACGT]+')) AS n_valid, count(*) AS n_words FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id",
    "graph_degree": GRAPH + "SELECT d.kmer, coalesce(n, 0) AS degree FROM nodes d LEFT JOIN (SELECT kmer, count(*) AS n FROM links GROUP BY kmer) n ON n.kmer = d.kmer",
    "position_lines": D + "SELECT doc_id, string_agg(CAST(\"count\" AS VARCHAR), ' ' ORDER BY pos) AS line FROM occ GROUP BY doc_id",
    "by_abundance": D + "SELECT * FROM exact WHERE \"count\" = 1",
    "high_abundance": D + ", t AS (SELECT min(doc_id) AS stop FROM (SELECT doc_id, row_number() OVER (PARTITION BY kmer ORDER BY doc_id, pos) AS nth FROM km) WHERE nth >= 50) SELECT kmer, count(*) AS \"count\" FROM km, t WHERE stop IS NULL OR doc_id <= stop GROUP BY kmer HAVING count(*) >= 2",
    "present_kmers": D + "SELECT sample, kmer FROM exact WHERE kmer IN (SELECT kmer FROM exact WHERE sample = 'src0')",
    "kmer_strands": D + "SELECT w, f, r, least(f, r) AS u FROM codes",
    "kmer_arrays": D + "SELECT doc_id, count(*) AS n, CAST(sum(kmer) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS forward FROM words JOIN codes USING (w) GROUP BY doc_id",
    "n_as_a": "SELECT doc_id, count(*) FILTER (length(w) >= 3 AND regexp_full_match(upper(w), '[ACGTN]+')) AS n_valid FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id",
    "sketch_unique": D + "SELECT sample, count(*) FILTER (x = 1 OR y = 1) AS n_unique FROM (SELECT sample, row_number() OVER (PARTITION BY sample, kmer % 9973 ORDER BY doc_id, pos) AS x, row_number() OVER (PARTITION BY sample, kmer % 9967 ORDER BY doc_id, pos) AS y FROM km) GROUP BY sample",
    "big_counts": _dna(5)
    + """SELECT sample, kmer, CAST(least(count(*) + 255, 65535) AS INTEGER) AS "count" FROM (SELECT sample, kmer, count(*) OVER (PARTITION BY sample, kmer % 499 ORDER BY doc_id, pos) AS x, count(*) OVER (PARTITION BY sample, kmer % 503 ORDER BY doc_id, pos) AS y FROM km)
 WHERE x > 255 AND y > 255 GROUP BY sample, kmer""",
    "presence_union": D + "SELECT DISTINCT tab, bin FROM bins",
    "approx_unique_band": D + "SELECT sample, count(*) AS n_unique, true AS near FROM exact GROUP BY sample",
    "cardinality_union": D + "SELECT count(DISTINCT kmer) AS n_unique, true AS near FROM exact",
    "sample_names": """SELECT doc_id, CASE WHEN contains(b, '.kh') THEN split_part(b, '.kh', 1) WHEN contains(b, '.ct') THEN split_part(b, '.ct', 1) WHEN contains(b, '.cg') THEN split_part(b, '.cg', 1) WHEN contains(b, '.countgraph') THEN split_part(b, '.countgraph', 1) ELSE b END AS name, split_part(b, '.', 1) AS short
 FROM (SELECT doc_id, source || '-' || doc_id || ['.kh', '.ct.gz', '.cg', '.countgraph', '.x.y'][doc_id % 5 + 1] AS b FROM documents)""",
    "name_partitions": "SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS part FROM documents",
    "valid_pairs": "SELECT doc_id, doc_id % 3 <> 0 AS slash, doc_id % 3 <> 0 AS word, false AS wrong FROM documents",
    "graph_reach": GRAPH
    + """, d0 AS (SELECT kmer, 0 AS depth FROM nodes WHERE kmer < 500), d1 AS (SELECT DISTINCT o AS kmer, 1 AS depth FROM links JOIN d0 USING (kmer)), d2 AS (SELECT DISTINCT o AS kmer, 2 AS depth FROM links JOIN d1 USING (kmer)),
 d3 AS (SELECT DISTINCT o AS kmer, 3 AS depth FROM links JOIN d2 USING (kmer)) SELECT kmer, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY kmer""",
    "connected_size": GRAPH
    + """, free AS (SELECT * FROM links WHERE NOT (o % 3 = 0 AND o >= 5) AND NOT (kmer % 3 = 0 AND kmer >= 5)), d0 AS (SELECT kmer FROM nodes WHERE kmer < 5 ), d1 AS (SELECT o AS kmer FROM free JOIN d0 USING (kmer)), d2 AS (SELECT o AS kmer FROM free JOIN d1 USING (kmer))
 SELECT least(count(*), 1000) AS size FROM (SELECT kmer FROM d0 UNION SELECT kmer FROM d1 UNION SELECT kmer FROM d2)""",
    "partition_components": CC + "SELECT kmer, partition_id FROM parts",
    "partition_distribution": CC + "SELECT size, count(*) AS n_partitions FROM (SELECT count(*) AS size FROM parts GROUP BY partition_id) GROUP BY size",
    "partition_coverage": CC + "SELECT partition_id, CAST(floor(avg(n)) AS BIGINT) AS coverage FROM parts JOIN (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) USING (kmer) GROUP BY partition_id",
    "largest_partitions": CC + "SELECT partition_id, count(*) AS size FROM parts GROUP BY partition_id ORDER BY size DESC, partition_id DESC LIMIT 2",
    "read_partitions": _dna(9)
    + """SELECT r.doc_id, coalesce(p, -1) AS partition_id, length(seq) >= 9 AND coalesce(n, 1) <= 1 AS single FROM reads r LEFT JOIN (SELECT doc_id, arg_min(kmer % 5003, pos) AS p, count(DISTINCT kmer % 5003) AS n FROM km WHERE kmer % 5003 < 20 GROUP BY doc_id) USING (doc_id)""",
    "join_by_path": _dna(9)
    + """, met AS (SELECT DISTINCT doc_id, kmer % 5003 AS p FROM km), pairs AS (SELECT DISTINCT p AS x, m AS y FROM met JOIN (SELECT doc_id, min(p) AS m FROM met GROUP BY doc_id) USING (doc_id)), twoway AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs)"""
    + _cc("SELECT DISTINCT p FROM met", "twoway")
    + "SELECT DISTINCT kmer, label AS partition_id FROM km JOIN cc ON node = kmer % 5003",
    "merge_partitions": _dna(9)
    + """, n AS (SELECT DISTINCT kmer FROM km), a AS (SELECT kmer, kmer % 5003 AS p FROM n WHERE kmer % 2 = 0), b AS (SELECT kmer, 10000 + kmer % 7001 AS p FROM n WHERE kmer % 3 = 0),
 pairs AS (SELECT DISTINCT a.p AS x, b.p AS y FROM a JOIN b USING (kmer)), twoway AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs)"""
    + _cc("SELECT p FROM a UNION SELECT p FROM b", "twoway")
    + "SELECT DISTINCT kmer, label % 10000 AS partition_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN cc ON node = p",
    "compare_sets": D + "SELECT count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (y AND NOT x) AS only_second, count(*) FILTER (x AND y) AS both FROM (SELECT kmer, bool_or(sample = 'src0') AS x, bool_or(sample <> 'src0') AS y FROM exact GROUP BY kmer)",
    "divide_tags": _dna(9) + "SELECT kmer FROM (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS n FROM (SELECT DISTINCT kmer FROM km)) WHERE n % 10 = 0",
    "tag_labels": _dna(9) + "SELECT kmer AS tag, string_agg(sample, ',' ORDER BY sample) AS labels FROM exact GROUP BY kmer",
    "trim_on_stop_tags": D + f"SELECT r.doc_id, CASE WHEN length(seq) < {DNA_K} THEN 0 ELSE coalesce(x, length(seq)) END AS usable FROM reads r LEFT JOIN (SELECT doc_id, min(pos) + {DNA_K - 2} AS x FROM km WHERE kmer IN (SELECT kmer FROM exact WHERE sample = 'src1') GROUP BY doc_id) USING (doc_id)",
    "stop_tag_positions": D + "SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM km WHERE kmer IN (SELECT kmer FROM exact WHERE sample = 'src1') GROUP BY doc_id",
    "counts_by_every_position": D + "SELECT pos, count(*) AS n_kmers FROM occ WHERE \"count\" = 1 GROUP BY pos",
    "revcomp_decode_all": D + "SELECT doc_id, pos, reverse(translate(w, 'ACGT', 'TGCA')) AS revcomp, CASE WHEN kmer = f THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END AS canonical, f AS forward FROM words JOIN codes USING (w)",
    "tag_links": WALK + "SELECT x AS tag, y AS found FROM met",
    "tag_partitions": WALK + _cc("SELECT kmer FROM nodes WHERE kmer % 97 = 0", "met") + "SELECT node AS kmer, label AS partition_id FROM cc",
    "transfer_to_stop_tags": D
    + """, n AS (SELECT kmer, count(*) AS c FROM km GROUP BY kmer)
SELECT kmer, CAST(c + CASE WHEN kmer % 2 = 0 AND c < 5 THEN 1 ELSE 0 END AS BIGINT) AS "count", kmer % 2 = 0 AND c >= 5 AS stop FROM n""",
    "tag_lines": _dna(GRAPH_K) + "SELECT kmer, any_value(CASE WHEN kmer = f THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END) AS value FROM codes WHERE kmer % 97 = 0 GROUP BY kmer",
    "unassigned_reads": D + "SELECT doc_id FROM reads WHERE doc_id NOT IN (SELECT doc_id FROM km WHERE kmer IN (SELECT kmer FROM km WHERE sample = 'src0'))",
    "largest_split": _dna(GRAPH_K)
    + """, held AS (SELECT DISTINCT kmer, kmer % 5003 AS partition_id FROM codes)
SELECT kmer, partition_id FROM held WHERE partition_id = (SELECT partition_id FROM held GROUP BY partition_id ORDER BY count(*) DESC, partition_id DESC LIMIT 1)""",
}
