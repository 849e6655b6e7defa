"""Most frequent values by external sort and run-length counting.

Rows are range-partitioned by (value, entry id), so that a value holding a third of all rows is spread over many ranges,
and sorted there by Spark, which spills. A pass over each sorted range removes re-sent entries, counts runs and keeps a
bounded heap; only the first and last run of a range can go on in another one, so these leave it as they are. What is
merged after is k + 3 rows a range, one of them the range's sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _runs(k: int):
    out = pa.schema([("value", pa.int64()), ("total", pa.int64())])

    def emit(value: list[int | None], total: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(total, pa.int64())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, int]] = []  # (total, -value), the k largest runs that ended inside the range
        first_done, open_value, open_total, last_id, everything = False, None, 0, None, 0

        def close(value: int, total: int) -> pa.RecordBatch | None:
            nonlocal first_done
            if not first_done:
                first_done = True
                return emit([value], [total])
            if len(heap) < k:
                heapq.heappush(heap, (total, -value))
            elif (total, -value) > heap[0]:
                heapq.heapreplace(heap, (total, -value))
            return None

        for b in batches:
            if not b.num_rows:
                continue
            v, i, c = (b.column(n).to_numpy() for n in range(3))
            fresh = np.concatenate(([open_value is None or v[0] != open_value or i[0] != last_id], (v[1:] != v[:-1]) | (i[1:] != i[:-1])))
            last_id = i[-1]
            at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sums = np.add.reduceat(np.where(fresh, c, 0), at)
            values = v[at]
            everything += int(sums.sum())
            if open_value is not None and values[0] == open_value:
                open_total += int(sums[0])
                values, sums = values[1:], sums[1:]
            if not len(values):
                continue
            if open_value is not None and (x := close(open_value, open_total)) is not None:
                yield x
            inner_v, inner_s = values[:-1], sums[:-1]
            if len(inner_v) and not first_done:
                yield close(int(inner_v[0]), int(inner_s[0]))
                inner_v, inner_s = inner_v[1:], inner_s[1:]
            if len(inner_v) > k:  # only the batch's own k largest can enter the heap
                keep = np.lexsort((inner_v, -inner_s))[:k]
                inner_v, inner_s = inner_v[keep], inner_s[keep]
            for value, total in zip(inner_v.tolist(), inner_s.tolist()):
                close(value, total)
            open_value, open_total = int(values[-1]), int(sums[-1])
        if open_value is not None:
            yield emit([None, open_value, *(-x for _, x in heap)], [everything, open_total, *(t for t, _ in heap)])

    return run


def _largest(df: DataFrame, value: str, count: str, entry_id: str, k: int, partitions: int | None) -> DataFrame:
    """value, total of the k largest sums, and before them a row with a null value: the sum over all values."""
    rows = df.select(F.col(value).cast("long").alias("value"), F.col(entry_id).cast("long").alias("id"), F.col(count).cast("long").alias("c")).where("value IS NOT NULL AND id IS NOT NULL AND c IS NOT NULL")
    ranged = rows.repartitionByRange(partitions, "value", "id") if partitions else rows.repartitionByRange("value", "id")
    runs = ranged.sortWithinPartitions("value", "id").mapInArrow(_runs(k), "value long, total long")
    return runs.groupBy("value").agg(F.sum("total").alias("total")).orderBy(F.col("value").isNull().desc(), F.desc("total"), "value").limit(k + 1)


def frequent_values(df: DataFrame, value: str, count: str, entry_id: str, k: int, partitions: int | None = None) -> DataFrame:
    """value, total of the k values with the largest sums of count over distinct entries; the sums are exact.

    df: integral columns value, count and entry_id; other columns are ignored. Rows with a null in any of the three are
    left out; rows that repeat value and entry_id count once. Ties in total go to the smaller value. Fewer than k
    values give as many rows, an empty table none. Memory of a task: one batch and k runs.
    """
    return _largest(df, value, count, entry_id, k, partitions).where("value IS NOT NULL")


def heavy_values(df: DataFrame, value: str, count: str, entry_id: str, parts: int, partitions: int | None = None) -> DataFrame:
    """value, total of the values that make up at least 1/parts of the sum over all distinct entries.

    Counts must not be negative: then at most `parts` values can, so the `parts` largest hold them all. Otherwise as
    frequent_values. The grand total comes from the same pass; the window holds parts + 1 rows.
    """
    top = _largest(df, value, count, entry_id, parts, partitions)
    grand = F.max(F.when(F.col("value").isNull(), F.col("total"))).over(W.partitionBy(F.lit(0)))
    return top.withColumn("grand", grand).where(f"value IS NOT NULL AND total * {int(parts)} >= grand AND total > 0").select("value", "total")
