"""A training-data pipeline over documents: toxic texts go, near copies go, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before and returns a DataFrame; all but the last
return the columns of documents, whatever else those are called.

Defined cases, for all stages: a null text is an empty one, is clean, linked with nothing and repeats nothing; ids may be null.
Rows that repeat doc_id and text are copies of each other like any equal texts: one row stays. Of a group of near copies stays
the row of the smallest doc_id (a null id only where no row of the group has one), of those the one of the smallest hash of id
and text, of those the one whose columns come first as JSON. Texts without words are linked with nothing, so all their rows
stay. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import jaccard, packing, suffixes, toxicity
from strandlake.llm.common import drop_tables, few, fresh, shared_table, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; columns named score or predicted stay as they are."""
    ship(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.probability(model)(F.col("text")) < 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at 0.8 one row stays; texts without words stay."""
    found = shared_table(jaccard.ngram_components(docs, n=5, percent=80).where("root IS NOT NULL").groupBy("root", "k", "doc_id").agg(F.count("*").alias("rows")))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k"))["k"].alias("first"))
    key = fresh(docs, "__k")
    marked = shared_table(found.join(first, "root").where("k <> first OR rows > 1").select(F.col("k").alias(key), (F.col("k") == F.col("first")).alias("repeated")))
    drop_tables(found)
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    kept = keyed.join(few(marked.select(key)), key, "left_anti").select(*names)
    repeated = marked.where("repeated").select(key)
    if repeated.isEmpty():
        return kept
    row = F.struct(*names)
    one = keyed.join(few(repeated), key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go; texts of which nothing is left go."""
    return suffixes.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences of 2048 tokens."""
    return packing.pack_pieces(packing.cut(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: The stages learn, hash and pack; SQL cannot express them. tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
        if last is not None:
            drop_tables(last)
        last = docs
    return docs
