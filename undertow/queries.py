"""All queries of the engine by name, each over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from undertow import plans, stored
from undertow.operators import kernels

Query = Callable[[SparkSession, str], DataFrame]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of all windows of all panels, for the numerical kernels."""
    return plans.hub(spark, sf_dir, "hist")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def kernel(name: str) -> Query:
    return lambda spark, sf_dir: rounded(kernels.components(history(spark, sf_dir), name))


def spectral(name: str) -> Query:
    """A query over the power of every bin, which SQL sums in time that grows with the square of the length."""
    return lambda spark, sf_dir: plans.CATALOG.run(spark, name, sf_dir, power=kernels.powers(history(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models ranked by mean scaled error over the rolling-origin windows of all panels."""
    return plans.query(spark, sf_dir, "r2_official_accuracy")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: (lambda spark, sf_dir, n=name: plans.query(spark, sf_dir, n)) for name in plans.CATALOG.queries}
    out |= {f"{p}_{name}": kernel(name) for p, name in (("p2", "multi_seasonal"), ("p3", "time_varying_seasonality"), ("p5", "nonlinear_persistence"), ("p7", "common_factor"), ("p10", "covariate_impulse_response"))}
    out |= {name: spectral(name) for name in ("f2_dominant_frequencies", "k11_candidate_pools")}
    out["f2_fft_bins"] = lambda spark, sf_dir: kernels.spectra(history(spark, sf_dir))
    out["f11_factors"] = lambda spark, sf_dir: rounded(kernels.factors(history(spark, sf_dir)))
    out["m1_smoothing"] = lambda spark, sf_dir: rounded(kernels.forecast(history(spark, sf_dir), kernels.smoothing))
    out["m3_harmonic_regression"] = lambda spark, sf_dir: rounded(kernels.forecast(history(spark, sf_dir), kernels.harmonic_regression))
    return out | stored.queries()


def oracle_sql() -> dict[str, str]:
    return {name: plans.oracle(name) for name in plans.CATALOG.queries} | stored.oracle_sql()
