"""Arrow IPC streams of series as a Spark data source, one partition for each file.

    spark.dataSource.register(ArrowSeriesSource)
    spark.read.format("arrow_series").load(folder)

A folder holds one ``data-*.arrow`` stream with item_id, freq and target, the latter a list for each channel or a
plain list, and optionally past_feat_dynamic_real and feat_dynamic_real. Batches go to Spark as they are read, so
a task holds one batch. Missing values (NaN) become nulls.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MATRIX = "array<array<double>>"
REQUIRED = ("item_id", "target", "freq")


class ArrowSeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_series"

    def schema(self) -> str:
        return f"item_id string, freq string, target {MATRIX}, past_feat_dynamic_real {MATRIX}, feat_dynamic_real {MATRIX}"

    def reader(self, schema) -> DataSourceReader:
        return ArrowSeriesReader(self.options["path"])


class ArrowSeriesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "data-*.arrow"))) if os.path.isdir(self.path) else [self.path]
        if len(files) != 1:
            raise ValueError(f"{self.path} holds {len(files)} data-*.arrow streams; one is needed")
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        matrix = pa.list_(pa.list_(pa.float64()))

        def clean(value):
            if value is None:
                return None
            rows = value if value and isinstance(value[0], list) else [value]
            return [[None if v is None or v != v else float(v) for v in row] for row in rows]

        with pa.memory_map(partition.value) as source:
            stream = pa.ipc.open_stream(source)
            missing = [c for c in REQUIRED if c not in stream.schema.names]
            if missing:
                raise ValueError(f"{partition.value} lacks {missing}")
            for batch in stream:
                rows = batch.to_pylist()
                columns = [pa.array([r["item_id"] for r in rows], pa.string()), pa.array([r["freq"] for r in rows], pa.string())]
                columns += [pa.array([clean(r.get(c)) for r in rows], matrix) for c in ("target", "past_feat_dynamic_real", "feat_dynamic_real")]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "freq", "target", "past_feat_dynamic_real", "feat_dynamic_real"])
