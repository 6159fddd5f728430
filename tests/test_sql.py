"""Queries of the comparison engine against the same in SQL."""

import os

import duckdb
import pytest

from strandlake.plans import graph_queries
from strandlake.plans import queries as Q

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = Q.QUERIES | graph_queries.QUERIES, Q.SQL | graph_queries.SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(tuple, a[columns].values.tolist()), key=str) == sorted(map(tuple, b[columns].values.tolist()), key=str)


def test_counts_by_every_position(spark, con):
    got = sorted(map(tuple, Q.QUERIES["counts_by_every_position"](spark, DIR).collect()))
    assert got == sorted(con.sql(Q.D + 'SELECT pos, count(*) AS n_kmers FROM occ WHERE "count" = 1 GROUP BY pos').fetchall()) and got[-1][0] >= 200


def test_revcomp_decode_of_every_kmer(spark, con):
    rc = "reverse(translate(w, 'ACGT', 'TGCA'))"
    want = con.sql(Q.D + f"SELECT doc_id, pos, {rc}, CASE WHEN kmer = f THEN w ELSE {rc} END, f FROM words JOIN codes USING (w)").fetchall()
    got = Q.QUERIES["revcomp_decode_all"](spark, DIR).select("doc_id", "pos", "revcomp", "canonical", "forward").collect()
    assert len(got) > 1000 and sorted(map(tuple, got)) == sorted(want)
