"""Deeply nested records to flat linked tables (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.jsonindex import items, linked

#: json_field: table, record key, JSON column, steps to the innermost items.
FIELDS = {
    "taxa.record_json": ("taxa", "speciedex_id", "record_json", [("key", "history"), ("each",), ("key", "sources"), ("each",), ("item", ("providerid",))]),
    "assertions.assertion_json": ("assertions", "assertion_hash", "assertion_json", [("key", "extra"), ("key", "distribution"), ("each",), ("key", "areas"), ("each",), ("item", ("code",))]),
    "iconforge_taxa.lineage_json": ("iconforge_taxa", "taxon_key", "lineage_json", [("each",), ("key", "metadata"), ("key", "alternates"), ("each",), ("item", ("name",))]),
}


def nested_items(df: DataFrame, key: str, text: str, steps: list[tuple], chunk: int = 1024) -> DataFrame:
    """record_key, outer_pos, inner_pos, item: the innermost items of two nested arrays of a JSON column.

    Rows keep the key of their record and their places in both arrays, counted from 0 as delivered. Text that is
    null, empty or no valid JSON has no content; text coded more than once counts as its content. Rows repeat as
    their records repeat. Null keys are kept. `chunk` texts are indexed at a time.
    """
    schema = pa.schema([("record_key", pa.string()), ("outer_pos", pa.int32()), ("inner_pos", pa.int32()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                keys, rows = part.column(0).to_pylist(), items(part.column(1).to_pylist(), steps)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i, _, _ in rows], pa.string()), pa.array([p[0] for _, p, _ in rows], pa.int32()), pa.array([p[1] for _, p, _ in rows], pa.int32()), pa.array([v for _, _, v in rows], pa.string())],
                        schema=schema,
                    )

    # A text without the last array's name (or an escaped letter that may spell it) holds no item.
    name = [s[1] for s in steps if s[0] == "key"][-1]
    may = F.col(text).contains(name) | F.col(text).contains("\\u")
    return df.where(may).select(F.col(key), F.col(text)).mapInArrow(run, "record_key string, outer_pos int, inner_pos int, item string")


def tables(df: DataFrame, key: str, text: str, chunk: int = 1024) -> DataFrame:
    """record_key, path, row_key, parent_key, pos, fields: all objects and plain array elements of a JSON column as linked rows.

    The paths are found in the data: the rows of one path are one flat table, row_key is unique within a record, and
    parent_key is the row_key of the row around (null at the root), so tables join on (record_key, parent_key). fields
    maps the names of plain fields to their text. Text that is null, empty or no valid JSON gives no rows, text coded
    more than once counts as its content, null record keys are kept, and rows repeat as their records repeat.
    """
    kinds = "record_key string, path string, row_key string, parent_key string, pos int, fields map<string,string>"
    schema = pa.schema([("record_key", pa.string()), ("path", pa.string()), ("row_key", pa.string()), ("parent_key", pa.string()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                keys, rows = part.column(0).to_pylist(), linked(part.column(1).to_pylist())
                if rows:
                    cols = [[keys[r[0]] for r in rows], [r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], [list(r[5].items()) for r in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, kinds)
