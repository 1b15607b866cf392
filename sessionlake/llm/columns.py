"""Reading columns out of Arrow batches in slices, so that memory stays bounded whatever the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters of text that one slice may hold, unless a single text is longer.
SLICE_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of a batch; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    start, held, chars = 0, [], 0
    for row, value in enumerate(column):
        value = value.as_py() or ""
        if held and chars + len(value) > most:
            yield start, held
            start, held, chars = row, [], 0
        held.append(value)
        chars += len(value)
    if held:
        yield start, held


def result(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of the given schema from lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
