"""How filters interact: for every order of the filters, what each step keeps, removes and what others had removed before it.

1. Duplicates by partition refinement: texts are split by their number of code points, then by the hashes of successive blocks
   (each SPREAD times as long as the ones before together). A round reads the texts, keeps those of classes that had two rows or more
   in the round before, and counts the classes that the next block splits them into; classes of one row are dropped. The full texts that
   are left after the last block are grouped by themselves: equal hashes prove nothing, so each text has its own least id.
2. Every row becomes a mask of the filters that it fails; masks are counted for each part, at most 2 ** filters of them.
3. A part's counts are read once for each order and step: what a step removes fails its filter and none before it.

Classes and least ids are written tables of a few numbers a class, broadcast where they are counted as few, and else met by a
shuffle that deals a class's rows to SALTS tasks. Texts themselves are shuffled only where they may be copies, one a task and text.

Defined cases: null text is empty, a null part is the empty string; a null doc_id comes after all others (it fails as a copy where
the text has an id; null ids are equal to each other); rows that repeat doc_id and text are equal, so none is larger; a document is
good or toxic where any of its labels says so; null doc_ids have no labels; without documents there are no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, shared_table

FIRST, SPREAD, SALTS, FEW = 256, 16, 16, 1_000_000
SPACE = r"[\x20\x09-\x0D]+"


def checks(text: Column) -> dict[str, Column]:
    """The failure conditions of single texts: few words, few distinct words, many capitals, odd characters."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def refined(text: Column, level: int) -> Column:
    """The class of a text after its length and so many blocks."""
    key, at, size = F.xxhash64(F.length(text)), 0, FIRST
    for _ in range(level):
        key = F.xxhash64(key, F.substring(text, F.lit(at + 1), F.lit(size)))
        at += size
        size = at * (SPREAD - 1)
    return key


def levels(longest: int) -> int:
    """Blocks that cover so many code points."""
    n, at = 1, FIRST
    while at < longest:
        n, at = n + 1, at * SPREAD
    return n


def meet(rows: DataFrame, classes: DataFrame, key: str, how: str, salt: Column) -> DataFrame:
    """rows joined with a written table of classes, one row a key: broadcast where few, else dealt to SALTS tasks a class."""
    if classes.count() <= FEW:
        return rows.join(F.broadcast(classes), key, how)
    every = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(every, [key, "__salt"], how).drop("__salt")


def copies(docs: DataFrame) -> DataFrame:
    """(class, text, least, texts) of every text that two rows or more of docs (doc_id, text without nulls) have: least is its
    least doc_id, texts the number of such texts in the class, which is 1 but for colliding hashes. A written table."""
    text = F.col("text")
    live, level, last = None, 0, 1
    while level <= last:
        own = docs.select(F.length(text).alias("n"), *([refined(text, level - 1).alias("before")] if level else []), refined(text, level).alias("class"), F.xxhash64("doc_id", F.length(text)).alias("__h"))
        if live is not None:
            own = meet(own, live, "before", "left_semi", F.col("__h"))
        now = shared_table(own.groupBy("class").agg(F.count("*").alias("rows"), F.max("n").alias("n")).where("rows > 1").select(F.col("class").alias("before"), "n"))
        if live is not None:
            drop_tables(live)
        live = now
        last = levels(live.agg(F.max("n")).first()[0] or 0)
        level += 1
    left = meet(docs.select("doc_id", "text", refined(text, level - 1).alias("before")), live.select("before"), "before", "left_semi", F.xxhash64("doc_id"))
    same = shared_table(left.groupBy(F.col("before").alias("class"), "text").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")).where("rows > 1").withColumn("level", F.lit(level - 1)))
    drop_tables(live)
    return same


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text without nulls, other columns) with copy: whether a smaller doc_id has the same text."""
    same = copies(docs)
    level = (same.select("level").first() or [0])[0]
    per = same.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"))
    one = shared_table(per.where("texts = 1 AND least IS NOT NULL").select("class", "least"))
    after = (F.col("doc_id") > F.col("least")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
    rows = docs.withColumn("class", refined(F.col("text"), level))
    many = shared_table(per.where("texts > 1").select("class"))
    if many.isEmpty():
        return meet(rows, one, "class", "left", F.xxhash64("doc_id")).withColumn("copy", F.coalesce(after, F.lit(False))).drop("class", "least")
    clear = meet(meet(rows, many, "class", "left_anti", F.xxhash64("doc_id")), one, "class", "left", F.xxhash64("doc_id"))
    named = same.join(many, "class", "left_semi").select("class", "text", "least")
    mixed = meet(rows, many, "class", "left_semi", F.xxhash64("doc_id")).join(named, ["class", "text"], "left").select(*clear.columns)
    return clear.unionByName(mixed).withColumn("copy", F.coalesce(after, F.lit(False))).drop("class", "least")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all parts, orders and steps."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")))
    failed = checks(F.col("text")) | {"E": F.col("copy")}
    letters = "".join(failed)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    mask = sum((F.when(failed[x], bit[x]).otherwise(0) for x in letters), F.lit(0))
    said = rows.select("doc_id", "part", mask.alias("mask")).join(known, "doc_id", "left").groupBy("part", "mask")
    cells = said.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))

    count = F.bit_count("mask")
    orders = len(list(permutations(letters)))
    # of the filters that a document fails each comes first in the same share of the orders
    shares = F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(bit[x])) != 0, F.col("n") * orders / count).otherwise(0)).cast("long") for x in letters))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"), shares.alias("shares"))

    order, step = F.col("filter_order"), F.col("step")
    place = F.instr(F.lit(letters), F.substring(order, step, F.lit(1)))
    before = sum((F.when(F.instr(order, x) < step, bit[x]).otherwise(0) for x in letters), F.lit(0))
    at = parts.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))))
    at = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("own", F.pow(F.lit(2), place - 1).cast("int")).withColumn("before", before)

    def total(what: str, fits) -> Column:
        return F.aggregate(F.filter("cells", lambda c: fits(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + c[what])

    own, before = F.col("own"), F.col("before")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    return at.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.element_at("shares", place).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), failed AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN doc_id > least OR (doc_id IS NULL AND least IS NOT NULL) THEN 1 ELSE 0 END AS e
  FROM words
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, a + b + c + d + e AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter FROM orders, range(1, 6) AS r(step)
), flat AS (
  SELECT part, fails, n, good, toxic, x, CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS own, f FROM cells, letters
), shapley AS (
  SELECT part, x, CAST(sum(CASE WHEN own = 1 THEN n * 120 // fails ELSE 0 END) AS BIGINT) AS shapley FROM flat GROUP BY part, x
), met AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, own,
    (CASE WHEN instr(filter_order, 'A') < step THEN f.A ELSE 0 END) + (CASE WHEN instr(filter_order, 'B') < step THEN f.B ELSE 0 END)
    + (CASE WHEN instr(filter_order, 'C') < step THEN f.C ELSE 0 END) + (CASE WHEN instr(filter_order, 'D') < step THEN f.D ELSE 0 END)
    + (CASE WHEN instr(filter_order, 'E') < step THEN f.E ELSE 0 END) AS earlier
  FROM flat JOIN steps ON x = letter
)
SELECT met.part, filter_order, step,
  CAST(sum(CASE WHEN own = 0 AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN own = 1 AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN own = 1 AND earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN own = 1 AND earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN own = 1 AND earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  any_value(shapley) AS shapley
FROM met JOIN shapley ON met.part = shapley.part AND met.letter = shapley.x
GROUP BY met.part, filter_order, step
"""
