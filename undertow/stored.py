"""Queries that go through stored artifacts: each writes a relation into the shared folder and reads it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from undertow import plans
from undertow.sources import artifacts

PAYLOAD = "coordinate double, gain double, min_macro double, max_macro double, status string"


def folder(spark: SparkSession, name: str) -> str:
    return f"{plans.shared_folder(spark)}/stored-{uuid.uuid4().hex}/{name}"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts written as typed keys and a payload, read with the payload's schema, of which two columns are asked."""
    path = folder(spark, "contracts")
    rows = plans.hub(spark, sf_dir, "contract").select("sample_id", "capability_id", F.col("level").cast("long").alias("capability_level"), "coordinate", "gain", "min_macro", "max_macro", "status")
    artifacts.write_contracts(rows, path)
    back = artifacts.read_contracts(spark, path, PAYLOAD)
    return back.select("sample_id", "capability_id", "capability_level", F.round("payload.gain", 6).alias("gain"), "payload.status")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts written as one row of floats each, read as cells and held against what was written."""
    path = folder(spark, "predictions")
    cells = plans.hub(spark, sf_dir, "fcst").select("model_id", F.col("window_id").alias("sample_id"), "channel_idx", "step", "yhat")
    artifacts.write_predictions(cells, path)
    both = artifacts.read_predictions(spark, path).withColumnRenamed("yhat", "stored").join(cells, ["model_id", "sample_id", "channel_idx", "step"])
    close = F.bool_and(F.abs(F.col("stored") - F.col("yhat")) <= 1e-6 * F.greatest(F.abs("yhat"), F.lit(1.0)))
    return both.groupBy("model_id", "sample_id").agg(F.count("*").alias("cells"), close.alias("close"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy rows written under a fixed schema."""
    path = folder(spark, "metrics")
    artifacts.write_metrics(plans.hub(spark, sf_dir, "accuracy"), path, "model_id string, window_id string, mase double, mae double, cells int")
    return spark.read.parquet(path).select("model_id", "window_id", F.round("mase", 6).alias("mase"), F.round("mae", 6).alias("mae"), "cells")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as JSON lines."""
    path = folder(spark, "windows.jsonl")
    rows = plans.hub(spark, sf_dir, "win").select("dataset", "window_id", "origin", "h")
    artifacts.write_json_lines(rows, path)
    return artifacts.read_json_lines(spark, path, rows.schema)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage binds of the tables that it reads: rows and a digest, and that a second reading agrees."""
    out = []
    for name in ("region", "nation", "supplier"):
        path = f"{sf_dir}/{name}.parquet"
        record = artifacts.parquet_record(spark, path)
        out.append((name, record["row_count"], artifacts.read_pinned(spark, path, record["sha256"]).count() == record["row_count"]))
    return spark.createDataFrame(out, "name string, row_count long, verified boolean")


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of another run, from CSV: models by mean error."""
    path = folder(spark, "external.csv")
    artifacts.write_csv(plans.hub(spark, sf_dir, "accuracy").select("model_id", "window_id", "mase"), path)
    rows = artifacts.read_metric_rows(spark, path, "model_id string, window_id string, mase double")
    return rows.groupBy("model_id").agg(F.count("*").alias("rows_"), F.round(F.avg("mase"), 6).alias("mase_mean"))


def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the CSV sink, numbers with ten significant digits."""
    path = folder(spark, "text.csv")
    artifacts.write_csv(plans.hub(spark, sf_dir, "accuracy").select("model_id", "window_id", "mase"), path)
    return spark.read.text(path).where("value NOT LIKE 'model_id,%'").select(F.split("value", ",")[0].alias("model_id"), F.split("value", ",")[1].alias("window_id"), F.col("value").alias("line"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"s8_stored_contracts": contracts, "s10_stored_predictions": predictions, "s12_stored_metrics": metrics, "s14_json_lines": json_lines, "s15_table_records": records, "s16_external_metrics": external, "s17_csv_lines": csv_text}


#: A query's rows without the detour, over relations of the catalog.
DIRECT = {
    "s8_stored_contracts": "SELECT sample_id, capability_id, cast(level AS bigint) AS capability_level, $EXACT(gain) AS gain, status FROM contract",
    "s10_stored_predictions": "SELECT model_id, window_id AS sample_id, count(*) AS cells, true AS close FROM fcst GROUP BY model_id, window_id",
    "s12_stored_metrics": "SELECT model_id, window_id, $EXACT(mase) AS mase, $EXACT(mae) AS mae, cast(cells AS int) AS cells FROM accuracy",
    "s14_json_lines": "SELECT dataset, window_id, origin, h FROM win",
    "s15_table_records": "SELECT 'region' AS name, count(*) AS row_count, true AS verified FROM region UNION ALL SELECT 'nation', count(*), true FROM nation UNION ALL SELECT 'supplier', count(*), true FROM supplier",
    "s16_external_metrics": "SELECT model_id, count(*) AS rows_, $EXACT(avg(mase)) AS mase_mean FROM accuracy GROUP BY model_id",
}


def oracle_sql() -> dict[str, str]:
    return {name: plans.direct(sql) for name, sql in DIRECT.items()}
