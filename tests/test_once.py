"""Steps that many queries share: k-mers are counted once a query, reads looked up by few k-mers first, sweeps made from tags."""

import contextlib
import io

import pyarrow as pa
import pytest

from strandlake.functions import kmers as K
from strandlake.operators import counting, spectrum, traversal
from strandlake.plans import queries

from .test_tagging import VALID, kmers, reads_of
from .test_tagging import K as SIZE
from .test_traversal import NODES, TAGS, frame, visit
from .test_traversal import nodes as nodes  # a fixture

READS = reads_of(5, 80)


def test_numbers_in_pieces(monkeypatch):
    words = [s for _, s in VALID] + ["ACGT", ""]
    whole = K.numbers_of(pa.array(words), SIZE).to_pylist()
    monkeypatch.setattr(K, "CHUNK", 50)
    assert K.numbers_of(pa.array(words), SIZE).to_pylist() == whole == [kmers(s) if len(s) >= SIZE else [] for s in words]
    assert K.numbers_of(pa.array(words)[3:9], SIZE).to_pylist() == whole[3:9] and K.numbers_of(pa.array([None, "AC"]), SIZE).to_pylist() == [[], []]


def test_occurrences_number_texts_once(spark):
    """Counts were made from texts of their own, and joined."""
    with contextlib.redirect_stdout(io.StringIO()) as said:
        queries.occurrences(spark, "/root/testdata/sf0.001").explain()
    assert said.getvalue().count("ArrowEvalPython") == 1


def test_totals_and_lookups(spark):
    reads = spark.createDataFrame(READS, "doc_id long, sequence string").repartition(3)
    valid = {i: kmers(s.upper()) for i, s in READS if s and len(s) >= SIZE and set(s.upper()) <= set("ACGT")}
    got = {r["kmer"]: r["count"] for r in counting.kmer_totals(reads, SIZE).collect()}
    every = [x for own in valid.values() for x in own]
    assert got == {x: every.count(x) for x in set(every)}
    for table in (set(every[::40]), set(every), set()):
        met = {i for i, own in valid.items() if table & set(own)}
        found = [r["doc_id"] for r in spectrum.reads_meeting(reads, SIZE, frame(spark, table), ["doc_id"]).collect()]
        assert sorted(found) == sorted(met)
        assert {r["doc_id"] for r in spectrum.reads_not_meeting(reads, SIZE, frame(spark, table), ["doc_id"]).collect()} == set(valid) - met


@pytest.mark.parametrize("radius", [1, 3])
def test_sweep_from_tags(spark, nodes, radius):
    stop, rows, want = set(NODES[::17]), [], set()
    for i, s in VALID[:30]:
        own = kmers(s)
        rows += [(i, x) for x in own]
        want |= {(i, x) for x in visit(own, radius, stop, set(TAGS), multi=True)[1]}
    got = traversal.sweep(nodes, spark.createDataFrame(rows, "source long, kmer long"), frame(spark, TAGS), SIZE, radius, frame(spark, stop))
    assert set(map(tuple, got.collect())) == want and want


def test_batches_of_reads_are_bounded(spark):
    """A batch held 10 000 reads, and eight bytes for each of their bases."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    reads = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('ACGT', 2000) AS sequence")
    sizes = counting.valid_reads(reads, SIZE).select("sequence").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    n = [r["n"] for r in sizes.collect()]
    assert sum(n) == 4000 and max(n) * 8000 < 1 << 22
