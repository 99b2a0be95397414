"""Queries of the engine, and the SQL that a second engine can check them with."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from undertow.plans import base, metrics, ops
from undertow.plans.dialect import TABLES, Catalog


def catalog() -> Catalog:
    """All relations and queries."""
    c = Catalog()
    base.install(c)
    for part in (ops.windows, ops.gates, ops.features, ops.perturbations, ops.validation, ops.adaptation, metrics.rows, metrics.aggregates, metrics.ranks, metrics.resampling, metrics.joins):
        part(c)
    return c


CATALOG = catalog()

#: Relations that many queries read. A session writes each once for a folder of tables, as Parquet in the shared folder,
#: and reads it from there: plans stay small, columns are pruned, and lost executors cost nothing that was written.
HUBS = ("panel_sparse", "panel", "win", "hist", "fut", "channel_scale", "mase_scale", "fit", "fcst", "cell", "task_accuracy", "accuracy", "direction", "loading", "event_plan", "profile", "profile_fit", "unit_cell", "context_distance", "treatment", "distance_gate", "unit_fcst", "effect", "effect_summary", "contract", "adapted", "residual", "power", "imputed", "group_state", "ablation_row", "boot", "stratum_boot", "scored", "zscore", "gain", "decay")
_kept: dict[tuple[str, str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where written relations go: spark.checkpoint.dir, or, for a local master without it, a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="undertow-relations-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def hub(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        path = f"{shared_folder(spark)}/relations-{uuid.uuid4().hex}/{name}"
        made = query(spark, sf_dir, name)
        made.write.parquet(path)
        _kept[key] = spark.read.schema(made.schema).parquet(path)
    return _kept[key]


def forget(spark: SparkSession) -> None:
    """Remove what this session has written; later queries write it again."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop(key).inputFiles()[0]).getParent().getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables of a folder, on top of the hubs below it."""
    others = frozenset(HUBS) - {name}
    body = " ".join(CATALOG.sql[n] for n in CATALOG.needs(name, others))
    read = {h: hub(spark, sf_dir, h) for h in HUBS if h in others and re.search(rf"\b(?:FROM|JOIN)\s+{h}\b", body)}
    return CATALOG.run(spark, name, sf_dir, **read)


def oracle(name: str) -> str:
    return CATALOG.text(name, False)


def direct(sql: str) -> str:
    """SQL over relations of the catalog, for the second engine."""
    once = Catalog(dict(CATALOG.sql), dict(CATALOG.other), [])
    once.add("direct", sql)
    return once.text("direct", False)
