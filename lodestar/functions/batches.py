"""Columns computed in Python from whole texts, a slice of a few megabytes at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes that Python objects are made of at a time; a batch of Spark's has up to 64 MB.
PIECE = 1 << 20


def column(work, kind: str):
    """A UDF of type `kind` that calls work(values, ...), lists of equal length, for about PIECE bytes at a time and gets a list.

    A worker holds a batch and its result as Arrow arrays, and one piece of them as objects.
    """
    target = to_arrow_type(T._parse_datatype_string(kind))

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        step = max(1, n * PIECE // max(1, sum(c.nbytes for c in columns)))
        made = [pa.array(work(*[c.slice(at, step).to_pylist() for c in columns]), target) for at in range(0, n, step)]
        return pa.concat_arrays(made) if made else pa.array([], target)

    return F.arrow_udf(run, kind)


def annotate(df: DataFrame, text_col: str, fields: str, make, keep: list[str], slice_bytes: int = 4 << 20) -> DataFrame:
    """`keep` columns of `df` plus `fields` (a DDL string) computed from whole texts.

    make() runs once a task and returns a function from a list of texts (UTF-8 bytes, null
    as b"") to a list of pyarrow arrays, one for each field. Batches are cut into slices of about
    slice_bytes of text, so a worker's memory follows the slice or the longest text.
    """
    added = T._parse_datatype_string(fields)
    bare = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("__text__"))
    schema = T.StructType([*bare.schema.fields[:-1], *added.fields])
    names = schema.names

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                texts = part.column(part.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(texts)], names=names)

    return bare.mapInArrow(run, schema)


def slices(batch, limit: int):
    """`batch` cut so that the binary last column of each part has about `limit` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
