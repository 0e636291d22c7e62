"""Scoring texts in Arrow batches, a bounded slice of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes (or ids) and rows handed to a scorer at once (a longer text comes alone, whole).
SLICE_CHARS = 1_000_000
SLICE_ROWS = 512

Scorer = Callable[[pa.RecordBatch], dict[str, list | pa.Array]]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch``, each of bounded size in ``column``."""
    values = batch.column(column)
    size = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = pc.fill_null(size(values), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n > SLICE_CHARS or i - lo >= SLICE_ROWS):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield batch.slice(lo)


def scored(rows: DataFrame, text_col: str, make_scorer: Callable[[], Scorer], fields: list[StructField], keep: bool = False) -> DataFrame:
    """``rows`` without ``text_col`` (unless ``keep``) plus ``fields``.  ``make_scorer`` runs once per
    task; its scorer maps a slice of rows to lists or arrays, one per field.  A column of
    ``rows`` that has a field's name gives way to it."""
    added = [f.name for f in fields]
    kept = [f for f in rows.schema.fields if f.name not in added and (keep or f.name != text_col)]
    rows = rows.select(*{**dict.fromkeys(f.name for f in kept), text_col: None})
    names = [f.name for f in kept]
    schema = StructType(kept + fields)
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for part in slices(batch, text_col):
                got = scorer(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], types[n]) for n in added], names=names + added
                )

    return rows.mapInArrow(run, schema)
