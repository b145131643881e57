"""Arrow record batches to plain rows and back, without copying tile samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<boolean>": pa.list_(pa.bool_()),
}


#: Bytes of lists and texts of an outgoing batch; a row that holds more goes alone.
BATCH_BYTES = 16 << 20


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(field.strip().split(" ")) for field in ddl.split(",")]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Each list as a view of the shared values."""
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _parts(column: pa.Array) -> list[list[dict]]:
    offsets = column.offsets.to_numpy()
    struct = column.values
    names = ("y", "x", "h", "w", "data")
    corners = [struct.field(n).to_numpy().tolist() for n in names[:-1]]
    parts = [dict(zip(names, values)) for values in zip(*corners, _lists(struct.field("data")))]
    return [parts[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _column(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = {kind.value_type.field(i).name for i in range(kind.value_type.num_fields)}
        if "data" in names:
            return _parts(column)
    elif pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
        return _lists(column)
    return column.to_pylist()


def _rows(batch: pa.RecordBatch) -> Iterator[SimpleNamespace]:
    names = batch.schema.names
    columns = [_column(batch.column(i)) for i in range(len(names))]
    for values in zip(*columns):
        yield SimpleNamespace(**dict(zip(names, values)))


def map_batches(df: DataFrame, fn: Callable[[Iterator[SimpleNamespace]], Iterable[tuple]], ddl: str) -> DataFrame:
    """Apply `fn` to the rows of each incoming batch; it yields tuples of whole columns."""
    fields = _fields(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
        for batch in batches:
            for columns in fn(_rows(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def map_rows(
    df: DataFrame, fn: Callable[[SimpleNamespace], Iterable[tuple]], ddl: str, per_task: bool = False
) -> DataFrame:
    """Apply `fn` to each row; it yields output tuples. Rows keep no order; carry a key.

    Rows of samples may be far larger than the rows they come from, so outgoing batches are
    bounded by bytes, however many rows an incoming batch has. With `per_task`, `fn()` is called once per task and returns the row function.
    """
    fields = _fields(ddl)
    wide = [i for i, (_, kind) in enumerate(fields) if kind in ("string", "binary") or kind.startswith("array")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
        row = fn() if per_task else fn

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([t[i] for t in out], type=f.type) for i, f in enumerate(schema)], schema=schema
            )

        for batch in batches:
            out, held = [], 0
            for r in _rows(batch):
                for t in row(r):
                    held += 64 + sum([8 * len(t[i]) for i in wide if t[i] is not None])
                    out.append(t)
                    if held > BATCH_BYTES:
                        yield packed(out)
                        out, held = [], 0
            yield packed(out)

    return df.mapInArrow(run, ddl)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[Iterator[SimpleNamespace]], Iterable[tuple]], ddl: str) -> DataFrame:
    """Apply `fn` to the rows of each group, which a task holds one at a time; it yields output tuples."""
    fields = _fields(ddl)

    def run(group: pa.Table) -> pa.Table:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
        out = list(fn(r for batch in group.to_batches() for r in _rows(batch)))
        return pa.table([pa.array([t[i] for t in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return df.groupBy(*keys).applyInArrow(run, ddl)
