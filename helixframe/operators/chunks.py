"""Pieces of records, so that no task handles a whole chromosome and no place carries one along."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the pieces that windows are cut out of.
PIECE = 1 << 12
#: Bytes that leave a task at once.
BATCH_BYTES = 1 << 23


def chunk_records(records: DataFrame, chunk: int = 1 << 20, overlap: int = 0, rec_id: str = "rec_id", seq: str = "seq", before: int = 0, more: list[str] | None = None) -> DataFrame:
    """rec_id, more, chunk_no, off, s: pieces of each sequence that start every `chunk` letters.

    A piece also holds `overlap` letters after and `before` letters ahead of it, as far as there are any; off is the
    place of its first letter. An empty sequence has one empty piece, a null one none. A sequence is cut in one pass.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    more = more or []
    rows = records.where(F.col(seq).isNotNull()).select(F.col(rec_id).alias("rec_id"), *more, F.col(seq).alias("s"))
    kinds = [rows.schema[c].dataType for c in ("rec_id", *more)]
    out = pa.schema([*((c, to_arrow_type(k)) for c, k in zip(("rec_id", *more), kinds)), ("chunk_no", pa.int64()), ("off", pa.int64()), ("s", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row: list[int] = []
            number: list[int] = []
            off: list[int] = []
            text: list[str | bytes] = []
            size = 0

            def batch() -> pa.RecordBatch:
                s = pa.array(text, pa.string() if text and isinstance(text[0], str) else pa.binary())
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int32())) for c in b.columns[:-1]), pa.array(number, pa.int64()), pa.array(off, pa.int64()), s.cast(pa.string())], schema=out)

            for i, scalar in enumerate(b.columns[-1]):
                data = memoryview(scalar.as_buffer() or b"")
                plain = bytes(data).isascii()
                whole = data if plain else scalar.as_py()
                for n in range(max(1, -(-len(whole) // chunk))):
                    at = max(0, n * chunk - before)
                    piece = whole[at : min(len(whole), (n + 1) * chunk + overlap)]
                    if text and isinstance(text[0], str) != isinstance(piece, str):
                        yield batch()
                        row, number, off, text, size = [], [], [], [], 0
                    row.append(i)
                    number.append(n)
                    off.append(at)
                    text.append(piece if isinstance(piece, str) else bytes(piece))
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        yield batch()
                        row, number, off, text, size = [], [], [], [], 0
            if row:
                yield batch()

    fields = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(("rec_id", *more), kinds))
    return rows.mapInArrow(run, f"{fields}, chunk_no long, off long, s string")


def fetch_windows(places: DataFrame, chunks: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """places (id, rec_id, start_pos, end_pos) with seq: windows of chunked sequences (without overlap), cut off at the record's end."""
    wanted = places.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"start_pos DIV {chunk}"), F.expr(f"(end_pos - 1) DIV {chunk}"))))
    parts = wanted.join(chunks, ["rec_id", "chunk_no"]).withColumn("_p", F.expr("substring(s, CAST(greatest(start_pos - off, 0) + 1 AS INT), CAST(end_pos - greatest(start_pos, off) AS INT))"))
    joined = parts.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "_p"))), lambda x: x["_p"]), "").alias("seq"))
    return places.join(joined, "id", "left")


def with_window(places: DataFrame, records: DataFrame, start: Column, end: Column, most: int, name: str) -> DataFrame:
    """places (rec_id, ...) with `name`: the letters from start to end of its record, at most `most`, cut off at its end.

    The start lies in the record. Each place meets one piece of some PIECE letters, so neither its cost nor its row grows
    with the record. Places of records that are missing or null are left out.
    """
    chunk = max(PIECE, most)
    pieces = chunk_records(records, chunk, overlap=most).select(F.col("rec_id").alias("_w_rec"), F.col("chunk_no").alias("_w_no"), F.col("off").alias("_w_off"), F.col("s").alias("_w_s"))
    wanted = places.withColumns({"_w_from": start.cast("long"), "_w_to": end.cast("long")}).withColumn("_w_at", F.expr(f"_w_from DIV {chunk}"))
    joined = wanted.join(pieces, (F.col("rec_id") == F.col("_w_rec")) & (F.col("_w_at") == F.col("_w_no")))
    cut = F.substring(F.col("_w_s"), (F.col("_w_from") - F.col("_w_off") + 1).cast("int"), (F.col("_w_to") - F.col("_w_from")).cast("int"))
    return joined.withColumn(name, cut).drop("_w_rec", "_w_no", "_w_off", "_w_s", "_w_from", "_w_to", "_w_at")
