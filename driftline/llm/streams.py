"""One hash over rows in order, for groups of any length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import ship


def ordered_sha256(df: DataFrame, by: list[str], order: list[str], piece: Column, between: str, name: str = "sha256") -> DataFrame:
    """(by, name): the SHA-256, in lowercase hex, of each group's pieces in order with `between` between them.

    A digest of a whole group is made in order by its nature: a group is one
    task's, which reads it row by row and keeps the state of one hash. Null
    groups are groups; null pieces are empty.
    """
    ship(df.sparkSession)
    n = len(by)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, names, out = None, None, [], []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in names], kinds[i]) for i in range(n)] + [pa.array(out, pa.string())]
            names.clear(), out.clear()
            return pa.RecordBatch.from_arrays(columns, [*by, name])

        kinds: list = []
        for rows in batches:
            kinds = [rows.schema.field(i).type for i in range(n)]
            for *key, said in zip(*(c.to_pylist() for c in rows.columns)):
                if key == now:
                    state.update(sep)
                else:
                    if now is not None:
                        names.append(now)
                        out.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                state.update((said or "").encode())
            if len(out) > 4096:
                yield batch()
        if now is not None:
            names.append(now)
            out.append(state.hexdigest())
            yield batch()

    sep = between.encode()
    fields = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    sorted_rows = df.withColumn("stream_piece", piece).repartition(*by).sortWithinPartitions(*by, *order)
    return sorted_rows.select(*by, "stream_piece").mapInArrow(taken, f"{fields}, `{name}` string")
