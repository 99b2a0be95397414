"""Helpers shared by the operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame


def arrow_types(schema: str) -> list:
    """Arrow types of a DDL string of simple columns."""
    import pyarrow as pa

    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return [known[part.split()[1]] for part in schema.split(",")]


def map_chunks(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], chunk: int = 512, chunk_bytes: int = 4_000_000) -> DataFrame:
    """Apply a function to small runs of rows, over Arrow batches.

    ``make`` runs once per task on the executor and returns a function that takes the columns of ``df``, in
    order, as lists, and gives tuples in the order of ``schema``. A run holds ``chunk`` rows at most, fewer
    where texts are long, so that a worker holds few texts at a time whatever their length.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches) -> Iterator:
        import pyarrow as pa

        rows, types = make(), arrow_types(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, min(chunk, int(chunk_bytes / max(1, batch.nbytes) * batch.num_rows)))
            for at in range(0, batch.num_rows, size):
                found = list(rows(*(c.to_pylist() for c in batch.slice(at, size).columns)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple | None]], **sizes) -> DataFrame:
    """``map_chunks`` with a function of one row, which returns a tuple, or None for no row."""

    def chunks():
        row = make()
        return lambda *columns: [out for values in zip(*columns) if (out := row(*values)) is not None]

    return map_chunks(df, schema, chunks, **sizes)
