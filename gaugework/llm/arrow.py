"""Rows of Arrow batches by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def strings(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, few of them Python objects at once."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def columns(batch: pa.RecordBatch) -> dict:
    """Numbers as arrays, all else as lists."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        numeric = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
        out[name] = column.to_numpy(zero_copy_only=False) if numeric and not column.null_count else column.to_pylist()
    return out


def _joined(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {
        name: np.concatenate([p[name] for p in parts]) if all(isinstance(p[name], np.ndarray) for p in parts) else [x for p in parts for x in p[name]]
        for name in parts[0]
    }


def key_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict]:
    """The rows of each key, of batches that are sorted by non-null integer keys."""
    pending: list[dict] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        ids = np.stack([cols[k] for k in keys])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if pending and last != tuple(ids[:, 0]):
            yield _joined(pending)
            pending = []
        for a, b in zip(cuts, cuts[1:]):
            pending.append({name: c[a:b] for name, c in cols.items()})
            if b < batch.num_rows:
                yield _joined(pending)
                pending = []
        last = tuple(ids[:, -1])
    if pending:
        yield _joined(pending)


def record_batch(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(fields: str) -> pa.Schema:
    """The Arrow schema of a DDL string, on the driver."""
    return to_arrow_schema(StructType.fromDDL(fields))
