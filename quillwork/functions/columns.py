"""Arrow columns as Python values, for workers: what to_pylist() gives, made by columns instead of by values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of Arrow that a worker turns to Python values at a time: values of Python need many times as much.
SLICE = 1 << 18


def values(a: pa.Array) -> list:
    """a.to_pylist() for arrays of scalars, structs and lists, nested as may be."""
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        out = [dict(zip(names, v, strict=True)) for v in zip(*[values(a.field(i)) for i in range(len(names))], strict=True)] if names else [{}] * len(a)
    elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        ends = a.offsets.to_pylist()
        first = ends[0] if ends else 0
        inner = values(a.values.slice(first, ends[-1] - first)) if ends else []
        out = [inner[i - first : j - first] for i, j in zip(ends, ends[1:])]
    elif pa.types.is_string(a.type) or pa.types.is_large_string(a.type) or not a.null_count and (pa.types.is_integer(a.type) or pa.types.is_float64(a.type) or pa.types.is_boolean(a.type)):
        return a.to_numpy(zero_copy_only=False).tolist()
    else:
        return a.to_pylist()
    return [v if there else None for v, there in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about `size` bytes, a row at least."""
    for b in batches:
        rows = max(1, b.num_rows * size // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
