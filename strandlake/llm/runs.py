"""Runs of equal keys in a global sort: every row meets the first row of its run, however many partitions a run spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, shared_table, tidy


def with_heads(rows: DataFrame, key: str, order: list[str], keep: str = "true") -> DataFrame:
    """rows sorted by (key, order); of each run of equal keys all rows but the first, with the first row's columns as h_<name>.
    key: a long without nulls. Only one row a partition reaches the driver. The result, of which only
    rows that fit keep stay, is a written table."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != key]
    kind_of = dict(rows.dtypes)
    columns = ", ".join([f"`{key}` long", *(f"`{c}` {kind_of[c]}" for c in names), *(f"`h_{c}` {kind_of[c]}" for c in names)])

    def run(batches):
        """mark 0: a row with its head; 1: of the partition's first run; 2: likewise, and first of it here; 3: the last
        run's head; 4: as 3, and all rows share one key."""
        from pyspark import TaskContext

        part, head, opening, one = TaskContext.get().partitionId(), None, None, True

        def out(mark, k, own, heads):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), part), pa.int32()), pa.array(mark, pa.int32()), pa.array(k, pa.int64()), *own.columns, *heads.columns],
                names=["part", "mark", key, *names, *(f"h_{c}" for c in names)],
            )

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k, own = b.column(key).to_numpy(), b.select(names)
            new = np.concatenate([[head is None or k[0] != head[0]], k[1:] != k[:-1]])
            opening = k[0] if opening is None else opening
            one = one and bool((k == opening).all())
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            keep = np.flatnonzero((first != np.arange(n)) | (k == opening))
            before = own if head is None else pa.Table.from_batches([head[1], own]).combine_chunks().to_batches()[0]
            at = first if head is None else first + 1
            mark = np.where(k[keep] != opening, 0, np.where(first[keep] == keep, 2, 1))
            yield out(mark, k[keep], own.take(pa.array(keep)), before.take(pa.array(at[keep])))
            head = (k[-1], before.take(pa.array(at[-1:])))
        if head is not None:
            yield out(np.array([4 if one else 3]), np.array([head[0]]), head[1], head[1])

    everything = [key, *order]
    ranged = rows.select(key, *names).repartitionByRange(*everything).sortWithinPartitions(*everything)
    found = shared_table(ranged.mapInArrow(tidy("words", run), f"part int, mark int, {columns}"))
    heads, last = [], None
    for r in found.where("mark >= 3").select("part", "mark", key, *(f"h_{c}" for c in names)).orderBy("part").collect():
        if last is not None:
            heads.append((r["part"], *last))
        if not (last is not None and r["mark"] == 4 and last[0] == r[key]):
            last = (r[key], *r[3:])
    edge = F.broadcast(spark.createDataFrame(heads, ", ".join(["part int", f"`{key}` long", *(f"`e_{c}` {kind_of[c]}" for c in names)])).withColumn("met", F.lit(True)))
    told = found.where("mark < 3").join(edge, ["part", key], "left")
    met = F.col("met") & (F.col("mark") > 0)
    out = shared_table(told.where(met | F.col("mark").isin(0, 1)).select(key, *names, *(F.when(met, F.col(f"e_{c}")).otherwise(F.col(f"h_{c}")).alias(f"h_{c}") for c in names)).where(keep))
    drop_tables(found)
    return out
