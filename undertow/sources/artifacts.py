"""Artifacts of a run: contracts, predictions, typed metrics, and the manifests that bind them."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

CONTRACT_SCHEMA, PREDICTION_SCHEMA = "undertow.contract.v1", "undertow.prediction.v1"
KEYS = ("record_kind", "dataset_id", "official_instance_id", "sample_id", "capability_id", "capability_level", "available")


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def write_contracts(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Typed keys and one JSON payload of all other columns, in alphabetical order so that the JSON is canonical."""
    rest = sorted(c for c in rows.columns if c not in KEYS)
    payload = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    out = rows.select(F.lit(CONTRACT_SCHEMA).alias("artifact_schema"), *[F.col(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in KEYS], payload.alias("payload_json"))
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_contracts(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Keys and the payload decoded by a DDL schema; a row of another schema is an error."""
    rows = spark.read.parquet(path)
    checked = F.when(F.col("artifact_schema") == CONTRACT_SCHEMA, F.col("payload_json")).otherwise(F.raise_error(F.concat(F.lit("unknown contract schema "), "artifact_schema")))
    return rows.select(*[k for k in KEYS if k in rows.columns], F.from_json(checked, payload).alias("payload"))


def write_predictions(cells: DataFrame, path: str) -> None:
    """One row for each model and window from cells (model_id, sample_id, channel_idx, step, yhat): the forecast
    flattened by step, as floats. A value that isn't finite is an error."""
    finite = F.when(F.isnan("yhat") | F.col("yhat").isNull() | (F.abs("yhat") == float("inf")), F.raise_error(F.lit("a forecast isn't finite"))).otherwise(F.col("yhat").cast("float"))
    rows = cells.withColumn("v", finite).groupBy("model_id", "sample_id").agg(
        (F.max("step") + 1).cast("int").alias("horizon"), (F.max("channel_idx") + 1).cast("int").alias("target_dim"), F.array_sort(F.collect_list(F.struct("step", "channel_idx", "v"))).alias("cells")
    )
    out = rows.select(F.lit(PREDICTION_SCHEMA).alias("schema_version"), "model_id", "sample_id", "horizon", "target_dim", F.col("cells.v").alias("forecast"))
    out.write.option("compression", "zstd").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Cells of stored predictions. A size that doesn't fit, or a model and window that come twice, is an error."""
    rows = spark.read.parquet(path)
    fits = F.when((F.size("forecast") == F.col("horizon") * F.col("target_dim")) & (F.col("schema_version") == PREDICTION_SCHEMA), F.col("forecast")).otherwise(F.raise_error(F.lit("a prediction doesn't fit its size or schema")))
    again = rows.groupBy("model_id", "sample_id").count().select("model_id", "sample_id", F.when(F.col("count") > 1, F.raise_error(F.lit("a prediction comes twice"))).otherwise(F.lit(1)).alias("one"))
    cells = rows.join(again, ["model_id", "sample_id"]).where("one = 1").select("model_id", "sample_id", "target_dim", F.posexplode(fits).alias("at", "yhat"))
    return cells.select("model_id", "sample_id", (F.col("at") % F.col("target_dim")).cast("long").alias("channel_idx"), F.floor(F.col("at") / F.col("target_dim")).cast("long").alias("step"), F.col("yhat").cast("double").alias("yhat"))


def write_metrics(rows: DataFrame, path: str, schema: str) -> None:
    """Rows under a fixed DDL schema."""
    typed = [F.col(part.split()[0]).cast(part.split()[1]) for part in schema.split(", ")]
    rows.select(*typed).write.option("compression", "zstd").parquet(path)


def file_record(path: str) -> dict:
    """Path, digest and size of a local file."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return {"path": str(path), "sha256": digest.hexdigest(), "bytes": os.path.getsize(path)}


def parquet_record(spark: SparkSession, path: str) -> dict:
    """Path, rows, files and bytes of a Parquet table, and the digest of its files' digests in order; read by Spark, wherever
    the table lies."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("sha256"), "length")
    digests = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ",").cast("binary"), 256), F.count("*"), F.sum("length")).first()
    return {"path": path, "sha256": digests[0], "files": digests[1], "bytes": digests[2], "row_count": spark.read.parquet(path).count()}


def read_pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A Parquet table whose digest is known; another digest is an error before anything is read."""
    found = parquet_record(spark, path)["sha256"]
    if found != sha256:
        raise ValueError(f"{path} has the digest {found}, not {sha256}")
    return spark.read.parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines under a schema; a line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(path: str, value) -> None:
    """A JSON file that is there whole or not at all."""
    target = Path(path)
    part = target.with_name(target.name + ".part")
    part.write_text(canonical_json(value), encoding="utf-8")
    os.replace(part, target)


def ensure_stage(folder: str, stage: str, config: dict, upstream: dict[str, str] | None = None) -> dict:
    """Bind a stage to its configuration and the digests of what it reads; a stage bound otherwise is an error."""
    contract = {"stage": stage, "config": config, "upstream": upstream or {}}
    contract["sha256"] = hashlib.sha256(canonical_json(contract).encode()).hexdigest()
    path = Path(folder) / f"{stage}.contract.json"
    if path.exists():
        known = json.loads(path.read_text(encoding="utf-8"))
        if known != contract:
            raise ValueError(f"stage {stage} in {folder} was made with another configuration")
        return known
    path.parent.mkdir(parents=True, exist_ok=True)
    write_json(str(path), contract)
    return contract


def read_metric_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of external metrics: CSV files with a header, or JSON documents with a list ``rows``, under a DDL schema."""
    if str(path).endswith(".csv"):
        return spark.read.csv(path, schema=schema, header=True)
    return spark.read.schema(f"rows array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).selectExpr("inline(rows)")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; doubles with ten significant digits."""
    rows.select(*[F.format_string("%.10g", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]).write.csv(path, header=True)
