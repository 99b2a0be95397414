import datetime
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from undertow import plans, queries
from undertow.functions.seeds import stable_seed, stable_seed_column
from undertow.operators import kernels
from undertow.plans import CATALOG
from undertow.plans.dialect import expand
from undertow.sources import artifacts
from undertow.sources.arrow_stream import ArrowSeriesSource


def panel(spark, series):
    """Given a dict of channel lists, the panel relation of one data set."""
    rows = [("d", "H", f"c{k}", k, t, None if v is None else float(v)) for k, values in enumerate(series) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, freq string, channel string, channel_idx long, t long, value double")


def win(spark, origins, h, m=1):
    return spark.createDataFrame([("d", "H", 0, h, m, k, o, f"w{k}") for k, o in enumerate(origins)], "dataset string, freq string, n long, h long, m long, w long, origin long, window_id string")


def test_macros_nest_and_split_at_their_own_commas():
    assert expand("$EXACT(greatest(a, $GET(b, 1)))", True) == "cast(round(greatest(a, get(b, 1)), 6) as double)"
    assert expand("$ARRAY('x', 'y')", False) == "['x', 'y']"


@pytest.mark.parametrize("lengths, h, origins", [((1000, 1200), 48, [856, 904, 952]), ((100,), 48, [52])])
def test_window_count_and_origins_follow_the_shortest_record(spark, lengths, h, origins):
    extent = spark.createDataFrame([("d", "H", datetime.datetime(2024, 1, 1), min(lengths))], "dataset string, freq string, lo timestamp_ntz, n long")
    got = CATALOG.run(spark, "w4_forecast_origins", extent=extent).orderBy("w").collect()
    assert [r.origin for r in got] == origins


def test_interpolation_holds_edges_and_fills_empty_channels(spark):
    sparse = panel(spark, [[None, 1, None, None, 4, None, 9], [None] * 7, [None, 5, None, None, None, None, None]])
    rows = CATALOG.run(spark, "n1_history_imputation", panel_sparse=sparse, win=win(spark, [6], 1)).orderBy("channel_idx", "t").collect()
    assert [r.value for r in rows] == [1, 1, 2, 3, 4, 4] + [0] * 6 + [5] * 6
    assert [r.observed for r in rows][:6] == [False, True, False, False, True, False]


def test_scale_falls_back_to_lag_one_and_then_to_one(spark):
    rows = CATALOG.run(spark, "g2_mase_scale", panel=panel(spark, [[1, 2] * 14, [3] * 28]), win=win(spark, [28], 0, 24)).orderBy("channel_idx").collect()
    assert [r.scale for r in rows] == [1, 1]


def test_perfect_forecasts_score_zero_and_effects_pool_by_sums(spark):
    cells = spark.createDataFrame([("m", "d", "w", 0, s, float(s), float(s), True, 2.0) for s in range(4)], "model_id string, dataset string, window_id string, channel_idx long, step long, yhat double, y double, observed boolean, scale double")
    assert CATALOG.run(spark, "a1_accuracy", cell=cells).first().mase == 0
    effect = spark.createDataFrame([("m", "d", "w1", "trend", 1, 0.0, 0.0, 100.0, 0.0, 1, 1.0, "scored", 0.0, 0.0, None), ("m", "d", "w2", "trend", 1, 0.0, 4.0, 1.0, 0.0, 1, 1.0, "scored", 2.0, 0.0, None)],
        "model_id string, dataset string, window_id string, capability_id string, level int, coordinate double, sse double, sst double, ssf double, cells long, truth_rms double, status string, nrmse double, amplitude_ratio double, correlation double")
    row = CATALOG.run(spark, "r3_effect_summary", effect=effect).first()
    assert row.mean_nrmse == 1.0 and row.pooled_nrmse == round(math.sqrt(4 / 101), 6)


def test_paired_models_use_common_tasks(spark):
    rows = spark.createDataFrame([("a", "t1", 1.0), ("a", "t2", 3.0), ("b", "t1", 2.0), ("b", "t2", 5.0), ("b", "t3", 9.0)], "model_id string, task_id string, mase double")
    row = CATALOG.run(spark, "b3_paired_models", task_accuracy=rows).first()
    assert (row.tasks, row.difference) == (2, -1.5)


def test_validation_reports_the_first_failed_rule(spark):
    columns = "sample_id string, window_id string, capability_id string, level int, gain double, coordinate double, min_macro double, max_macro double, max_channel double, rms double, artifact_schema string, stored_macro double, stored_status string, status string, stored_level int"
    base = ["w", "trend", 1, 1.0, 0.1, 0.2, 0.3, 0.4, 0.5, "v1", 0.2, "scored", "scored", 1]
    change = lambda k, v: base[:k] + [v] + base[k + 1 :]
    rows = [["ok", *base], ["schema", *change(9, "v0")], ["macro", *change(10, 0.3)], ["low", *change(5, 0.05)[:10], 0.05, *base[11:]], ["level", *change(13, 2)], ["status", *change(11, "x")]]
    got = {r.sample_id: r.reason for r in CATALOG.run(spark, "v7_first_failure", contract=spark.createDataFrame(rows, columns)).collect()}
    assert got == {"ok": None, "schema": "structural_schema_invalid", "macro": "macro_distance_mismatch", "low": "below_minimum_model_context_macro_distance", "level": "level_mismatch", "status": "scoring_gate_status_mismatch"}


def test_seeds_agree_in_both_forms(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(stable_seed_column(7, F.lit("a"), F.lit("b"))).first()[0] == stable_seed(7, "a", "b")


def test_kernels_find_what_was_put_in():
    t = np.arange(480)
    x = np.column_stack([np.sin(2 * np.pi * t / 24), np.sin(2 * np.pi * t / 24) * 2 + 0.01 * np.cos(t), np.sin(2 * np.pi * t / 24) * -1])
    assert 480 / kernels.dominant_bins(x[:, 0])[0] == 24
    rng = np.random.default_rng(0)
    unit = kernels.common_factor(x, 48, rng)
    assert unit.shape == (528, 3) and np.sign(unit[470, 0]) == -np.sign(unit[470, 2])
    with pytest.raises(kernels.Unavailable, match="d_ge_3"):
        kernels.common_factor(x[:, :2], 48, rng)
    assert kernels.multi_seasonal(x, 48, rng).shape == (528, 3)
    assert not kernels.independent(10, 20, 1000) and kernels.independent(10, 13, 1000)


def test_arrow_streams_become_series(spark, tmp_path):
    table = pa.table({"item_id": ["a", "b"], "target": [[1.0, float("nan")], [3.0, 4.0]], "freq": ["H", "H"]})
    with pa.OSFile(str(tmp_path / "data-0.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table)
    spark.dataSource.register(ArrowSeriesSource)
    rows = spark.read.format("arrow_series").load(str(tmp_path)).orderBy("item_id").collect()
    assert [r.target for r in rows] == [[[1.0, None]], [[3.0, 4.0]]]


def test_predictions_round_trip_and_reject_what_is_broken(spark, tmp_path):
    cells = spark.createDataFrame([("m", "s", c, h, 10.0 * h + c) for h in range(3) for c in range(2)], "model_id string, sample_id string, channel_idx long, step long, yhat double")
    artifacts.write_predictions(cells, str(tmp_path / "p"))
    back = artifacts.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(Exception, match="finite"):
        artifacts.write_predictions(cells.selectExpr("model_id", "sample_id", "channel_idx", "step", "double('NaN') as yhat"), str(tmp_path / "q"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    stored.union(stored).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(Exception, match="twice"):
        artifacts.read_predictions(spark, str(tmp_path / "twice")).collect()


def test_contracts_and_stages_are_bound(spark, tmp_path):
    rows = spark.createDataFrame([("s", "trend", 1.5)], "sample_id string, capability_id string, gain double")
    artifacts.write_contracts(rows, str(tmp_path / "c"))
    assert artifacts.read_contracts(spark, str(tmp_path / "c"), "gain double").first().payload.gain == 1.5
    first = artifacts.ensure_stage(str(tmp_path), "generation", {"seed": 1})
    assert artifacts.ensure_stage(str(tmp_path), "generation", {"seed": 1}) == first
    with pytest.raises(ValueError):
        artifacts.ensure_stage(str(tmp_path), "generation", {"seed": 2})


def test_hourly_stream_equals_batch(spark, tmp_path):
    from undertow.streaming import hourly

    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=20 * k), "ab"[k % 2], float(k)) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("hours").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    closed = {tuple(r) for r in spark.table("hours").collect()}
    assert closed and closed <= {tuple(r) for r in hourly(events).collect()}


def test_external_metrics_come_from_csv_and_json(spark, tmp_path):
    schema = "model_id string, mase double"
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], schema)
    artifacts.write_csv(rows, str(tmp_path / "m.csv"))
    assert sorted(r.model_id for r in artifacts.read_metric_rows(spark, str(tmp_path / "m.csv"), schema).collect()) == ["a", "b"]
    artifacts.write_json(str(tmp_path / "m.json"), {"rows": [{"model_id": "a", "mase": 1.5}]})
    assert artifacts.read_metric_rows(spark, str(tmp_path / "m.json"), schema).first().mase == 1.5


def test_kernels_see_every_window_of_every_panel(spark):
    folder = "/root/testdata/sf0.001"
    windows = {r.window_id for r in plans.hub(spark, folder, "win").select("window_id").collect()}
    assert {w.split("__")[0] for w in windows} == {"events_hourly", "orders_daily", "lineitem_daily"}
    for name in ("p2_multi_seasonal", "p3_time_varying_seasonality", "p5_nonlinear_persistence", "p7_common_factor", "p10_covariate_impulse_response", "f2_fft_bins", "f11_factors", "m1_smoothing", "m3_harmonic_regression"):
        assert {r.window_id for r in queries.queries()[name](spark, folder).select("window_id").distinct().collect()} == windows, name


def test_spectrum_covers_every_bin_channel_and_long_history(spark):
    n, t = 1200, np.arange(1200)
    series = [np.sin(2 * np.pi * b * t / n) + 0.5 * np.sin(2 * np.pi * (b + 100) * t / n) for b in (56, 84, 180)]
    given = {"panel": panel(spark, [x.tolist() for x in series]), "win": win(spark, [n, 672], 4)}
    for power in ({}, {"power": kernels.powers(CATALOG.run(spark, "hist", **given))}):
        rows = CATALOG.run(spark, "f2_dominant_frequencies", **given, **power).collect()
        top = {(r.window_id, r.channel_idx): r.bin for r in rows if r.place == 1}
        assert {k: top["w0", k] for k in range(3)} == {0: 56, 1: 84, 2: 180} and len(top) == 6
    spread = {r.window_id: (r.lo, r.hi) for r in CATALOG.run(spark, "power", **given).groupBy("window_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).collect()}
    assert spread == {"w0": (2, 300), "w1": (2, 168)}


def test_directed_regression_tries_every_lag_of_every_window(spark):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=240), rng.normal(size=240)
    y = np.concatenate([e[:24], x[:-24] + 0.1 * e[24:]])
    given = {"panel": panel(spark, [x.tolist(), y.tolist()]), "win": win(spark, [240, 80], 4)}
    rows = CATALOG.run(spark, "f12_directed_regression", **given).collect()
    assert {(r.window_id, r.lag) for r in rows} == {("w0", k) for k in range(1, 25)} | {("w1", k) for k in range(1, 11)}
    z = [(v - v.mean()) / v.std() for v in (x, y)]
    best = max((r for r in rows if r.window_id == "w0"), key=lambda r: r.gain)
    design = np.column_stack([np.ones(216), z[1][23:-1], z[0][:-24]])
    beta, left, base = (np.linalg.lstsq(design[:, :k], z[1][24:], rcond=None)[j] for k, j in ((3, 0), (3, 1), (2, 1)))
    assert (best.driver, best.responder, best.lag, best.beta, best.gain) == (0, 1, 24, pytest.approx(beta[2], abs=2e-6), pytest.approx(1 - left[0] / base[0], abs=2e-6))


def test_treated_accuracy_and_window_functions_keep_daily_panels(spark):
    for name in ("a1_treatment_accuracy", "k13_window_functions", "f12_directed_regression", "p9_cross_series", "f13_autoregression"):
        found = {r.window_id.split("__")[0] for r in queries.queries()[name](spark, "/root/testdata/sf0.001").select("window_id").distinct().collect()}
        assert found == {"events_hourly", "orders_daily", "lineitem_daily"}, name


def test_resampling_draws_as_often_as_the_survey_says(spark):
    rows = spark.createDataFrame([(m, f"t{k}", float(k * s)) for m, s in (("a", 1), ("b", 2)) for k in range(5)], "model_id string, task_id string, mase double")
    assert CATALOG.run(spark, "boot", task_accuracy=rows).groupBy("model_id").count().orderBy("model_id").collect() == [("a", 2000), ("b", 2000)]
    index = spark.createDataFrame([("trend", "w0", 0, 2), ("trend", "w1", 1, 2)], "capability_id string, window_id string, i long, n long")
    assert CATALOG.run(spark, "stratum_draw", stratum_index=index).select("rep").distinct().count() == 20000
    given = {"panel": panel(spark, [np.random.default_rng(k).normal(size=100).tolist() for k in range(2)]), "win": win(spark, [96], 4)}
    paths = CATALOG.run(spark, "f15_block_bootstrap", **given).collect()
    assert len({(r.channel_idx, r.step, r.path) for r in paths}) == len(paths) == 2 * 4 * 128
    for k in range(2):
        for s in range(4):
            assert abs(sum(r.innovation for r in paths if (r.channel_idx, r.step) == (k, s))) < 1e-3


def test_treatments_and_roles_return_every_row(spark):
    given = {"panel": panel(spark, [[k * (t % 7) + t for t in range(104)] for k in (1, 2, 3)]), "panel_sparse": panel(spark, [[None if t == 101 else k + t for t in range(104)] for k in (1, 2, 3)]), "win": win(spark, [96, 100], 4)}
    run = lambda name: CATALOG.run(spark, name, **given).collect()
    for name in ("p1_trend", "p4_regime_switching"):
        rows = run(name)
        assert len(rows) == len({(r.window_id, r.level, r.t) for r in rows}) == 5 * (100 + 104), name
    assert run("p6_predictable_intermittency") == []  # a horizon of 4 leaves no room for five gaps
    assert {r.reason for r in run("p13_availability") if r.capability_id == "predictable_intermittency"} == {"history_or_horizon_too_short_for_five_sparse_levels"}
    for name in ("p1_trend_profiles", "p4_regime_profiles"):  # of a window and step, the same for all channels
        assert len(rows := run(name)) == len({(r.window_id, r.t) for r in rows}) == 100 + 104, name
    assert len(run("s5_window_roles")) == 2 * 3 * 4 and len(run("p16_legacy_shift")) == 3 * (96 + 100)
    drawn = [(r.window_id, r.capability_id) for r in run("p0_loadings")]
    levels = [(r.window_id, r.capability_id) for r in run("p11_strength_scaling")]
    assert len(run("p12_contract_replay")) == sum(4 * drawn.count(k) for k in levels)
    filled = {(r.window_id, r.channel_idx, r.step): r.value for r in run("n3_covariate_imputation")}
    assert len(filled) == 24 and [filled["w1", k, 1] for k in range(3)] == [101, 102, 103]


UNIT = "model_id string, window_id string, dataset string, capability_id string, level int, channel_idx long, step long, unit double, observed boolean, mase double, unit_seasonal double, unit_last double, unit_hat double"
TREATMENT = "window_id string, dataset string, capability_id string, level int, coordinate double, distance double, cells long, future_rms double, gain double"


def test_effects_count_observed_cells_of_affected_channels(spark):
    treatment = spark.createDataFrame([(w, "d", "trend", 1, 0.1, 1.0, 1, 1.0, 1.0) for w in ("still", "hidden", "small", "same")], TREATMENT)
    cell = lambda w, c, s, unit, seen, mase, hat: ("m", w, "d", "trend", 1, c, s, unit, seen, mase, 0.0, 0.0, hat)
    rows = [cell("still", c, s, 2.0, s < 3, m, 0.0 if s < 3 else 99.0) for c, m in ((0, 2.0), (1, 4.0)) for s in range(4)]
    rows += [cell("hidden", 0, s, 2.0, False, 1.0, 1.0) for s in range(4)] + [cell("small", 0, s, 0.01, True, 1.0, 0.0) for s in range(4)]
    rows += [cell("same", 0, s, 1.0 + s, True, 1.0, 2.0 * (1.0 + s)) for s in range(4)]
    given = {"unit_fcst": spark.createDataFrame(rows, UNIT), "treatment": treatment}
    run = lambda name: {r.window_id: r for r in CATALOG.run(spark, name, **given).collect()}
    ratios, status, sums, shape = run("a5_effect_ratios"), run("a4_effect_status"), run("a3_paired_effect"), run("a6_effect_correlation")
    assert ratios["still"].nrmse == 1 and sums["still"].cells == 6 and ratios["still"].amplitude_ratio == 0 and shape["still"].correlation is None
    assert {w: r.status for w, r in status.items()} == {"still": "scored", "hidden": "unavailable_no_observed_effect_cell", "small": "unavailable_low_truth_effect", "same": "scored"}
    assert ratios["small"].nrmse is None and ratios["hidden"].nrmse is None and (sums["hidden"].cells, sums["hidden"].sst) == (0, 0)
    assert (ratios["same"].nrmse, ratios["same"].amplitude_ratio, shape["same"].correlation) == (1, 2, 1)


def test_decay_halves_from_its_peak(spark):
    rows = [(m, "w", "d", "trend", 1, 0, s, v, True, 1.0, 0.0, 0.0, hat * v) for m, hat in (("zero", 0.0), ("twice", 2.0)) for s, v in enumerate((1.0, 0.7, 0.49, 0.3, 0.1))]
    given = {"unit_fcst": spark.createDataFrame(rows, UNIT)}
    half = {r.model_id: r for r in CATALOG.run(spark, "a8_half_life", **given).collect()}
    shape = {r.model_id: r.shape_nrmse for r in CATALOG.run(spark, "a7_decay_profile", **given).collect()}
    assert half["zero"].measured == "censored_forecast_not_halved_in_horizon" and half["zero"].truth_half_life == 2 and half["zero"].status == "not_applicable"
    assert (half["twice"].measured, half["twice"].forecast_half_life, half["twice"].absolute_error) == ("scored", 2, 0) and shape == {"zero": 1.0, "twice": 0.0}


def test_ablation_takes_the_siblings_away(spark):
    one = lambda m, hat: [(m, "w", "d", "trend", 1, 0, s, 1.0, s != 3, 1.0, hat, hat, 1.0) for s in range(4)]
    given = {
        "unit_fcst": spark.createDataFrame(one("panel_blend", 0.0) + one("naive", 0.0), UNIT),
        "treatment": spark.createDataFrame([("w", "d", "trend", 1, 0.1, 1.0, 4, 1.0, 1.0)], TREATMENT),
        "ablation_plan": spark.createDataFrame([("w", "trend", 3, 0)], "window_id string, capability_id string, d long, assessed long"),
        "cell": spark.createDataFrame([(m, "d", "w", 0, s, 5.0, 5.0, True, 1.0) for m in ("panel_blend", "naive") for s in range(4)], "model_id string, dataset string, window_id string, channel_idx long, step long, yhat double, y double, observed boolean, scale double"),
        "fcst": spark.createDataFrame([(m, "w", "d", 0, s, 5.0) for m in ("seasonal_naive", "naive") for s in range(4)], "model_id string, window_id string, dataset string, channel_idx long, step long, yhat double"),
    }
    (row,) = CATALOG.run(spark, "a9_input_ablation", **given).collect()  # none for a model that reads one channel
    assert (row.model_id, row.full_mase, row.ablated_mase, row.degradation, row.change_rms, row.response_ratio) == ("panel_blend", 0, 1, 1, 1, 1)


def test_events_alternate_by_their_jitter_and_reach_the_future(spark):
    given = {"panel": panel(spark, [[k * (t % 7) + t for t in range(448)] for k in (1, 2)]), "panel_sparse": panel(spark, [[None if t % 3 else k + t for t in range(448)] for k in (1, 2)]), "win": win(spark, [400, 352], 48)}
    plans_ = CATALOG.run(spark, "event_plan", **given).collect()
    got = {}
    for r in CATALOG.run(spark, "event_profile", **given).collect():
        got.setdefault((r.window_id, r.level), {})[r.t] = r.v
    assert len(plans_) == 10
    for p in plans_:
        centres, at, k = [p.tip], p.tip, 0
        while (at := at - (p.a if k % 2 == 0 else p.b)) >= 0:
            centres.append(at)
            k += 1
        at, k = p.tip, 0
        while (at := at + (p.a if k % 2 == 0 else p.b)) < p.origin + p.h:
            centres.append(at)
            k += 1
        weights = [1.0 if p.kind == 0 or p.width == 1 else 1 - abs(o - 0.5 * (p.width - 1)) / max(1.0, 0.5 * (p.width - 1) + 1) if p.kind == 1 else math.exp(-math.log(2) * o / max(1.0, 0.5 * p.width)) for o in range(p.width)]
        want = {c + o: w for c in centres for o, w in enumerate(weights) if c + o < p.origin + p.h}
        assert {t: round(v, 12) for t, v in got[p.window_id, p.level].items() if v} == {t: round(v, 12) for t, v in want.items()}
        assert sum(c < p.origin for c in centres) >= 3 and any(t >= p.origin and t % 3 == 0 for t in want)


def test_trends_go_on_as_the_history_goes(spark):
    up, down, noise = [2.0 * t for t in range(120)], [-1.0 * t for t in range(120)], [float(t * 7919 % 13) for t in range(120)]
    given = {"panel": panel(spark, [up, down, noise]), "panel_sparse": panel(spark, [up, down, noise]), "win": win(spark, [100], 20)}
    signs = {r.channel_idx: r.direction for r in CATALOG.run(spark, "p0_loadings", **given).collect() if r.capability_id == "trend"}
    assert signs and set(signs) <= {0, 1} and all(signs[k] == {0: 1, 1: -1}[k] for k in signs)
    places = {r.level: min((q.t for q in CATALOG.run(spark, "p4_regime_switching", **given).where(f"level = {r.level}").collect() if q.profile > 0)) for r in CATALOG.run(spark, "p11_strength_scaling", **given).where("capability_id = 'regime_switching'").collect()}
    assert sorted(places, key=places.get) == [1, 2, 3, 4, 5]  # levels move the change, one gain for all
    assert len({r.gain for r in CATALOG.run(spark, "p11_strength_scaling", **given).where("capability_id = 'regime_switching'").collect()}) == 1


def test_pinned_tables_and_json_lines(spark, tmp_path):
    rows = spark.range(5).selectExpr("id", "cast(id AS string) AS name")
    rows.write.parquet(str(tmp_path / "t"))
    record = artifacts.parquet_record(spark, str(tmp_path / "t"))
    assert record["row_count"] == 5 and artifacts.read_pinned(spark, str(tmp_path / "t"), record["sha256"]).count() == 5
    with pytest.raises(ValueError, match="digest"):
        artifacts.read_pinned(spark, str(tmp_path / "t"), "0" * 64)
    artifacts.write_json_lines(rows, str(tmp_path / "l"))
    assert sorted(map(tuple, artifacts.read_json_lines(spark, str(tmp_path / "l"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))
