"""The engine's queries, in the order of the survey: each a relation over those of ``base``."""

from __future__ import annotations

from undertow.plans.dialect import Catalog


def windows(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("series", "SELECT dataset AS item_id, freq, channel_idx, $LIST(value, t) AS target, $LIST(t, t) AS past_cov FROM panel GROUP BY dataset, freq, channel_idx")
    q("s2_target_projection", "SELECT item_id, freq, channel_idx, $SIZE(target) AS length FROM (SELECT item_id, freq, channel_idx, target FROM series) q")
    q("s3_source_summary", "SELECT item_id, min(freq) AS freq, count(DISTINCT freq) AS frequencies, min($SIZE(target)) AS min_length, count(*) AS records FROM series GROUP BY item_id")
    q("s4_task_ids", "SELECT base_id, cast(n AS bigint) AS duplicates, CASE WHEN n > 1 THEN concat(base_id, '_', substr(md5(config), 1, 8)) ELSE base_id END AS task_id FROM (SELECT base_id, config, count(*) OVER (PARTITION BY base_id) AS n FROM (SELECT o_orderpriority AS base_id, concat(o_orderpriority, o_orderstatus) AS config FROM orders GROUP BY o_orderpriority, o_orderstatus) q) q")
    q("s5_window_roles", "SELECT u.window_id, u.channel_idx, u.step, $EXACT(u.value) AS truth, $EXACT(p.value) AS past_last, u.step % 7 AS known FROM fut u JOIN hist p ON u.window_id = p.window_id AND u.channel_idx = p.channel_idx AND p.t = p.origin - 1")
    c.add("flat", "SELECT model_id, window_id, max(channel_idx) + 1 AS d, max(step) + 1 AS h, $LIST(yhat, (step, channel_idx)) AS forecast FROM fcst GROUP BY model_id, window_id")
    q("s9_prediction_rows", "SELECT model_id, window_id, h AS horizon, d AS target_dim, cast($SIZE(forecast) AS bigint) AS cells, $FORALL(forecast, x, x IS NOT NULL AND NOT isnan(x)) AS finite FROM flat")
    q("s10_prediction_reshape", "SELECT model_id, window_id, step, cast($SIZE(row_) AS bigint) AS width, $EXACT($GET(row_, 0)) AS first_channel FROM (SELECT model_id, window_id, step, $CUT(forecast, cast(step * d + 1 AS int), cast(d AS int)) AS row_ FROM (SELECT *, $SEQ(0, h - 1) AS step FROM flat) q) q")
    q("s11_duplicate_predictions", "SELECT model_id, window_id, channel_idx, step, count(*) AS n FROM (SELECT model_id, window_id, channel_idx, step FROM fcst UNION ALL SELECT model_id, window_id, channel_idx, step FROM fcst WHERE model_id = 'naive' AND step = 0) q GROUP BY model_id, window_id, channel_idx, step HAVING count(*) > 1")

    q("w1_frequency", """SELECT raw_freq, CASE WHEN freq LIKE 'W-%' THEN 'W' ELSE regexp_extract(freq, '^([0-9]*)([AQMWDHTS])$', 2) END AS freq FROM (
        SELECT raw_freq, CASE raw_freq WHEN 'Y' THEN 'A' WHEN 'YE' THEN 'A' WHEN 'QE' THEN 'Q' WHEN 'ME' THEN 'M' WHEN 'h' THEN 'H' WHEN 'min' THEN 'T' WHEN 's' THEN 'S' ELSE raw_freq END AS freq
        FROM (VALUES ('H'), ('15T'), ('W-SUN'), ('ME'), ('h'), ('min'), ('QE'), ('YE'), ('10S'), ('D'), ('Y')) AS v(raw_freq)) q""")
    q("w2_prediction_length", "SELECT h.freq, t.term, cast(t.multiplier * h.base AS bigint) AS h, cast(t.multiplier * h.m4_base AS bigint) AS m4_h FROM horizon h CROSS JOIN term t")
    q("w3_window_count", "SELECT dataset, n AS min_length, cast(h AS bigint) AS h, windows, cast(1 AS bigint) AS m4_windows FROM task")
    q("w4_forecast_origins", "SELECT dataset, w, origin FROM win")
    c.add("label_cell", "SELECT w.window_id, w.dataset, p.channel_idx, p.t - w.origin AS step, p.value FROM win w JOIN panel_sparse p ON w.dataset = p.dataset AND p.t >= w.origin AND p.t < w.origin + w.h")
    q("w5_label_audit", "SELECT dataset, count(*) AS windows, count(CASE WHEN seen = cells THEN 1 END) AS complete, count(CASE WHEN seen > 0 AND seen < cells THEN 1 END) AS partially_missing, count(CASE WHEN seen = 0 THEN 1 END) AS fully_missing FROM (SELECT dataset, window_id, count(*) AS cells, count(value) AS seen FROM label_cell GROUP BY dataset, window_id) q GROUP BY dataset")
    q("w6_complete_windows", "SELECT dataset, window_id, count(*) AS cells FROM label_cell GROUP BY dataset, window_id HAVING count(value) = count(*)")
    q("w6_masked_windows", "SELECT dataset, window_id, count(value) AS observed_cells FROM label_cell GROUP BY dataset, window_id HAVING count(value) > 0")
    q("w7_time_major", "SELECT dataset, t, cast($SIZE(row_) AS bigint) AS d, $EXACT($GET(row_, 0)) AS c0, $EXACT($GET(row_, 1)) AS c1 FROM (SELECT dataset, t, $LIST(value, channel_idx) AS row_ FROM panel GROUP BY dataset, t) q")
    q("w8_covariate_orientation", "SELECT item_id, CASE WHEN rows_ = n THEN 'time_major' WHEN columns_ = n THEN 'channel_major' ELSE 'error' END AS orientation FROM (SELECT item_id, cast($SIZE($GET(cov, 0)) AS bigint) AS columns_, cast($SIZE(cov) AS bigint) AS rows_, n FROM (SELECT item_id, $ARRAY(past_cov, past_cov) AS cov, $SIZE(target) AS n FROM series WHERE channel_idx = 0) q) q")
    q("w9_covariate_roles", "SELECT item_id, cast($SIZE(names) AS bigint) AS k, $GET(names, 0) AS first_name, $GET(visible, 0) AS first_visible, $GET(visible, 2) AS last_visible FROM (SELECT item_id, $CAT($ARRAY('event_count', 'lag'), $ARRAY('hour')) AS names, $CAT($ARRAY(false, false), $ARRAY(true)) AS visible FROM series WHERE channel_idx = 0) q")
    q("w10_source_prefix", "SELECT dataset, window_id FROM (SELECT dataset, window_id, row_number() OVER (ORDER BY dataset, w) AS source_ord FROM win) q WHERE source_ord <= 5")
    # Tasks of the suite, with configurations and domains, and the configurations of the longer terms.
    c.add("registry", """SELECT * FROM (VALUES ('gift_electricity_h', 'electricity/H', 'Energy'), ('gift_solar_h', 'solar/H', 'Energy'), ('gift_ett1_h', 'ett1/H', 'Energy'), ('gift_ett2_h', 'ett2/H', 'Energy'), ('gift_jena_weather_h', 'jena_weather/H', 'Nature'), ('gift_kdd_cup_h', 'kdd_cup_2018_with_missing/H', 'Nature'),
        ('gift_loop_seattle_h', 'LOOP_SEATTLE/H', 'Transport'), ('gift_sz_taxi_h', 'SZ_TAXI/H', 'Transport'), ('gift_m_dense_h', 'M_DENSE/H', 'Transport'), ('gift_bitbrains_fast_h', 'bitbrains_fast_storage/H', 'Web/CloudOps'), ('gift_bitbrains_rnd_h', 'bitbrains_rnd/H', 'Web/CloudOps'), ('gift_bizitobs_l2c_h', 'bizitobs_l2c/H', 'Web/CloudOps'),
        ('gift_bizitobs_application', 'bizitobs_application', 'Web/CloudOps'), ('gift_bizitobs_service', 'bizitobs_service', 'Web/CloudOps'), ('gift_restaurant_d', 'restaurant', 'Business'), ('gift_hierarchical_sales_d', 'hierarchical_sales/D', 'Business'), ('gift_m4_hourly', 'm4_hourly', 'Mixed'), ('gift_us_births_d', 'us_births/D', 'Nature'), ('gift_saugeenday_d', 'saugeenday/D', 'Nature'), ('gift_temperature_rain_d', 'temperature_rain_with_missing', 'Nature')) AS v(dataset_id, config_id, domain)""")
    c.add("long_config", "SELECT * FROM (VALUES ('electricity/15T'), ('electricity/H'), ('solar/10T'), ('solar/H'), ('kdd_cup_2018_with_missing/H'), ('LOOP_SEATTLE/5T'), ('LOOP_SEATTLE/H'), ('SZ_TAXI/15T'), ('M_DENSE/H'), ('ett1/15T'), ('ett1/H'), ('ett2/15T'), ('ett2/H'), ('jena_weather/10T'), ('jena_weather/H'), ('bitbrains_fast_storage/5T'), ('bitbrains_rnd/5T'), ('bizitobs_application'), ('bizitobs_service'), ('bizitobs_l2c/5T'), ('bizitobs_l2c/H')) AS v(config_id)")
    q("w11_configured_suite", "SELECT 'short' AS term, dataset_id FROM registry UNION ALL SELECT 'medium', dataset_id FROM registry WHERE config_id IN (SELECT config_id FROM long_config) UNION ALL SELECT 'long', dataset_id FROM registry WHERE config_id IN (SELECT config_id FROM long_config)")
    q("w12_cutoff", "SELECT dataset, cutoff, CASE WHEN cutoff < 0 THEN n + cutoff ELSE cutoff END AS resolved FROM extent CROSS JOIN (VALUES (-48), (-2), (100)) AS v(cutoff)")
    q("w13_context_suffix", "SELECT k.model_id, p.window_id, count(*) AS cells, max(p.origin) < 32 AS below_minimum, $EXACT(sum(p.value)) AS total FROM hist p CROSS JOIN (SELECT 'short' AS model_id, 96 AS max_context UNION ALL SELECT 'medium', 512 UNION ALL SELECT model_id, max_context FROM context) k WHERE p.t >= p.origin - k.max_context GROUP BY k.model_id, p.window_id")
    q("w14_suffix_replay", "SELECT p.window_id, p.capability_id, p.level, k.ctx, count(*) AS cells, $EXACT(sum(p.v)) AS total, $EXACT(max(CASE WHEN p.t = p.origin - 1 THEN p.v END)) AS last_value FROM profile p CROSS JOIN (SELECT 96 AS ctx UNION ALL SELECT DISTINCT max_context FROM context) k WHERE p.t >= p.origin - k.ctx AND p.t < p.origin GROUP BY p.window_id, p.capability_id, p.level, k.ctx")
    q("w15_instance_audit", "SELECT w.dataset, count(DISTINCT w.window_id) AS instances, cast(sum(w.h) AS bigint) AS cells, min(w.origin) AS min_context, max(w.origin) AS max_context, count(DISTINCT k.channel_idx) AS target_dim FROM win w JOIN chan k ON w.dataset = k.dataset GROUP BY w.dataset")

    # Missing data and encodings, over the sparse panel.
    c.add("sparse_hist", "SELECT w.window_id, w.origin, p.channel_idx, p.t, p.value FROM win w JOIN panel_sparse p ON w.dataset = p.dataset AND p.t < w.origin")
    c.add("near", """SELECT window_id, origin, channel_idx, t, value, $LAST(value) OVER (PARTITION BY window_id, channel_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, $LAST(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY window_id, channel_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
        $FIRST(value) OVER (PARTITION BY window_id, channel_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, $FIRST(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY window_id, channel_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM sparse_hist""")
    c.add("imputed", "SELECT window_id, origin, channel_idx, t, value IS NOT NULL AS observed, CASE WHEN value IS NOT NULL THEN value WHEN t0 IS NULL AND t1 IS NULL THEN cast(0 AS double) WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM near")
    q("n1_history_imputation", "SELECT window_id, channel_idx, t, observed, $EXACT(value) AS value FROM imputed")
    q("n1_observed_fraction", "SELECT window_id, $EXACT(avg(CASE WHEN observed THEN cast(1 AS double) ELSE cast(0 AS double) END)) AS observed_fraction, count(DISTINCT CASE WHEN observed THEN channel_idx END) AS seen_channels FROM imputed GROUP BY window_id")
    q("n2_future_placeholder", "SELECT l.window_id, l.channel_idx, l.step, l.value IS NOT NULL AS observed, $EXACT(coalesce(l.value, i.value)) AS value FROM label_cell l JOIN imputed i ON l.window_id = i.window_id AND l.channel_idx = i.channel_idx AND i.t = i.origin - 1")
    q("n3_covariate_imputation", "SELECT l.window_id, l.channel_idx, l.step, $EXACT(coalesce(l.value, $LAST(l.value) OVER (PARTITION BY l.window_id, l.channel_idx ORDER BY l.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), i.value)) AS value FROM label_cell l JOIN imputed i ON l.window_id = i.window_id AND i.channel_idx = l.channel_idx AND i.t = i.origin - 1")
    q("n4_category_codes", "SELECT e.event_id, k.code FROM events e JOIN (SELECT event_type, cast(row_number() OVER (ORDER BY event_type) - 1 AS double) AS code FROM (SELECT DISTINCT event_type FROM events) q) k ON e.event_type = k.event_type")
    q("n5_covariate_types", """SELECT name, CASE WHEN n = 0 THEN 'continuous' WHEN distincts <= 2 AND is_binary THEN 'binary' ELSE 'continuous' END AS semantic_type FROM (SELECT name, count(v) AS n, count(DISTINCT v) AS distincts, bool_and(v IN (0, 1)) AS is_binary FROM (
        SELECT 'weekend' AS name, cast(t % 7 IN (5, 6) AS int) AS v FROM panel UNION ALL SELECT 'hour', cast(t % 24 AS int) FROM panel UNION ALL SELECT 'empty', cast(NULL AS int) FROM panel UNION ALL SELECT 'constant', 1 FROM panel) q GROUP BY name) q""")
    q("n6_past_only_fill", "SELECT window_id, channel_idx, cast($SIZE(filled) AS bigint) AS h, $EXACT($GET(filled, 0)) AS value FROM (SELECT window_id, channel_idx, $REPEAT(last_value, h) AS filled FROM fit) q")
    q("n7_default_seasonality", "SELECT freq, CASE WHEN freq LIKE '%H' THEN 24 WHEN freq LIKE '%D' THEN 7 WHEN freq LIKE '%M' THEN 12 WHEN freq LIKE '%W' THEN 52 ELSE 1 END AS m FROM (VALUES ('H'), ('D'), ('M'), ('W'), ('15T'), ('A'), ('6H')) AS v(freq)")


def gates(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    q("g1_channel_scale", "SELECT window_id, channel_idx, $EXACT(scale) AS scale FROM channel_scale")
    q("g2_mase_scale", "SELECT window_id, channel_idx, $EXACT(scale) AS scale FROM mase_scale")
    q("g3_scalar_scale", "SELECT window_id, $EXACT(avg(scale)) AS scale FROM mase_scale GROUP BY window_id")
    q("g4_effect_signal", "SELECT window_id, capability_id, level, $EXACT(raw_rms) AS raw_rms, $EXACT(future_rms) AS scaled_rms, cells FROM unit_future")
    q("g5_macro_distance", "SELECT window_id, capability_id, level, $EXACT(distance) AS distance FROM profile_fit")
    # Directions are 1 or -1 in units of a channel's scale, so every affected channel has the distance of the profile.
    c.add("distance_gate", "SELECT t.window_id, t.capability_id, t.level, min(t.gain * d.macro) AS min_macro, max(t.gain * d.macro) AS max_macro, max(t.gain * d.macro) AS max_channel FROM treatment t JOIN context_distance d ON t.window_id = d.window_id AND t.capability_id = d.capability_id AND t.level = d.level GROUP BY t.window_id, t.capability_id, t.level")
    c.add("gate_reason", "SELECT *, CASE WHEN min_macro < 0.10 - 1e-12 THEN 'below_minimum_model_context_macro_distance' WHEN max_macro > 2.0 + 1e-12 THEN 'above_maximum_model_context_macro_distance' WHEN max_channel > 3.0 + 1e-12 THEN 'above_maximum_model_context_channel_distance' END AS reason FROM distance_gate")
    q("g6_distance_gate", "SELECT window_id, capability_id, level, $EXACT(min_macro) AS min_macro, $EXACT(max_macro) AS max_macro, $EXACT(max_channel) AS max_channel, reason FROM gate_reason")
    q("g7_contexts", "SELECT t.term, w.window_id, least(w.origin, k.max_context) AS context_length, $JOINED(k.model_id) AS models FROM win w CROSS JOIN term t JOIN context k ON t.term = 'short' OR k.model_id <> 'tirex2' GROUP BY t.term, w.window_id, least(w.origin, k.max_context)")

    q("g8_dose_interval", "SELECT window_id, capability_id, level, $EXACT(lo) AS lo, $EXACT(hi) AS hi, lo <= hi + 1e-12 AS feasible FROM dose_interval")
    q("g9_shared_gain", "SELECT window_id, capability_id, $EXACT(weakest) AS weakest, $EXACT(weakest_future) AS weakest_future, $EXACT(gain) AS gain FROM shared_gain")
    c.add("scoring", "SELECT window_id, capability_id, level, coalesce(gain * future_rms, 0) AS rms, CASE WHEN cells = 0 THEN 'no_observed_affected_future_cell' WHEN gain * future_rms < 0.05 - 1e-12 THEN 'future_truth_effect_below_minimum' END AS reason FROM treatment")
    q("g10_scoring_gate", "SELECT window_id, capability_id, level, $EXACT(rms) AS rms, coalesce(reason, 'scored') AS status FROM scoring")
    c.add("third", "SELECT window_id, capability_id, level, ntile(3) OVER (PARTITION BY window_id, capability_id, level ORDER BY t) AS part, v FROM profile WHERE t >= origin")
    q("g11_horizon_support", "SELECT window_id, capability_id, level, $EXACT(tail / nullif(head, 0)) AS tail_head_ratio, coalesce(tail / nullif(head, 0) >= 0.5, false) AS supported FROM (SELECT window_id, capability_id, level, sqrt(avg(CASE WHEN part = 1 THEN v * v END)) AS head, sqrt(avg(CASE WHEN part = 3 THEN v * v END)) AS tail FROM third GROUP BY window_id, capability_id, level) q")
    q("g11_active_fraction", "SELECT window_id, capability_id, level, $EXACT(avg(CASE WHEN abs(v) >= 0.25 * peak AND peak > 1e-12 THEN cast(1 AS double) ELSE cast(0 AS double) END)) AS active_fraction FROM (SELECT window_id, capability_id, level, v, max(abs(v)) OVER (PARTITION BY window_id, capability_id, level) AS peak FROM profile WHERE t >= origin) q GROUP BY window_id, capability_id, level")
    q("g12_strict_future_effect", "SELECT window_id, capability_id, level FROM scoring WHERE reason IS NULL AND capability_id IN ('nonlinear_persistence', 'predictable_intermittency', 'covariate_impulse_response')")
    c.add("level_state", "SELECT g.window_id, g.capability_id, g.level, coalesce(g.reason, CASE WHEN g.capability_id = 'predictable_intermittency' THEN s.reason END) AS reason FROM gate_reason g JOIN scoring s ON g.window_id = s.window_id AND g.capability_id = s.capability_id AND g.level = s.level")
    c.add("group_state", """SELECT s.window_id, s.capability_id, coalesce(s.reason, l.reason) IS NULL AS available, coalesce(s.reason, l.reason) AS reason FROM structure_reason s
        LEFT JOIN (SELECT window_id, capability_id, min(CASE WHEN reason IS NOT NULL THEN concat('level_', cast(level AS string), '_', reason) END) AS reason FROM level_state GROUP BY window_id, capability_id) l ON s.window_id = l.window_id AND s.capability_id = l.capability_id""")
    q("g13_all_or_nothing", "SELECT window_id, capability_id, available, reason FROM group_state")


def features(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("xy", "SELECT window_id, dataset, channel_idx, t, origin, h, m, value, -1 + 2 * cast(t AS double) / (origin - 1) AS x FROM hist")
    c.add("line", "SELECT window_id, channel_idx, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM xy GROUP BY window_id, channel_idx")
    c.add("residual", "SELECT p.window_id, p.channel_idx, p.t, p.origin, p.m, p.value - l.a - l.b * p.x AS r FROM xy p JOIN line l ON p.window_id = l.window_id AND p.channel_idx = l.channel_idx")
    q("f1_linear_detrend", "SELECT window_id, channel_idx, $EXACT(sqrt(avg(r * r))) AS rms, count(*) AS n FROM residual GROUP BY window_id, channel_idx")
    c.add("probe", "SELECT q.*, 2 * pi() * q.bin * q.t / q.origin AS w FROM (SELECT *, $SEQ(2, floor(origin / 4)) AS bin FROM residual WHERE origin >= 24) q")
    c.add("power", "SELECT window_id, channel_idx, bin, sum(r * hann * cos(w)) * sum(r * hann * cos(w)) + sum(r * hann * sin(w)) * sum(r * hann * sin(w)) AS power FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t / (origin - 1)) AS hann FROM probe) q GROUP BY window_id, channel_idx, bin")
    q("f2_dominant_frequencies", "SELECT window_id, channel_idx, bin, cast(place AS bigint) AS place FROM (SELECT window_id, channel_idx, bin, row_number() OVER (PARTITION BY window_id, channel_idx ORDER BY power DESC, bin) AS place FROM power) q WHERE place <= 16")
    c.add("harmonic_sums", "SELECT window_id, channel_idx, half, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(s * r) AS sr, sum(c * r) AS cr, sum(r * r) AS rr, count(*) AS n FROM (SELECT window_id, channel_idx, CASE WHEN t < floor(origin / 2) THEN 1 ELSE 2 END AS half, sin(2 * pi() * t / m) AS s, cos(2 * pi() * t / m) AS c, r FROM residual) q GROUP BY window_id, channel_idx, half")
    c.add("harmonic", "SELECT window_id, channel_idx, half, (sr * cc - cr * sc) / nullif(ss * cc - sc * sc, 0) AS a, (cr * ss - sr * sc) / nullif(ss * cc - sc * sc, 0) AS b, sqrt(rr / n) AS rms FROM harmonic_sums")
    q("f3_harmonic_fit", "SELECT window_id, channel_idx, $EXACT((sr * cc - cr * sc) / nullif(ss * cc - sc * sc, 0)) AS sin_amplitude, $EXACT((cr * ss - sr * sc) / nullif(ss * cc - sc * sc, 0)) AS cos_amplitude FROM (SELECT window_id, channel_idx, sum(ss) AS ss, sum(cc) AS cc, sum(sc) AS sc, sum(sr) AS sr, sum(cr) AS cr FROM harmonic_sums GROUP BY window_id, channel_idx) q")
    c.add("wave", "SELECT f.window_id, f.channel_idx, s.step, f.a * sin(2 * pi() * (s.origin + s.step) / s.m) + f.b * cos(2 * pi() * (s.origin + s.step) / s.m) AS v FROM harmonic f JOIN steps s ON f.window_id = s.window_id AND f.channel_idx = s.channel_idx WHERE f.half = 2")
    q("f4_harmonic_synthesis", "SELECT window_id, channel_idx, step, $EXACT(v) AS value FROM wave")
    q("f5_normalised_harmonic", "SELECT w.window_id, w.channel_idx, w.step, $EXACT(w.v * s.scale / nullif(q.sd, 0)) AS value FROM wave w JOIN (SELECT window_id, channel_idx, stddev_pop(v) AS sd FROM wave GROUP BY window_id, channel_idx) q ON w.window_id = q.window_id AND w.channel_idx = q.channel_idx JOIN channel_scale s ON w.window_id = s.window_id AND w.channel_idx = s.channel_idx")
    q("f6_split_half_stability", "SELECT x.window_id, x.channel_idx, $EXACT((x.a * y.a + x.b * y.b) / nullif(sqrt(x.a * x.a + x.b * x.b) * sqrt(y.a * y.a + y.b * y.b), 0)) AS phase_cosine, $EXACT(least(sqrt(x.a * x.a + x.b * x.b), sqrt(y.a * y.a + y.b * y.b)) / nullif(greatest(sqrt(x.a * x.a + x.b * x.b), sqrt(y.a * y.a + y.b * y.b)), 0)) AS amplitude_ratio FROM harmonic x JOIN harmonic y ON x.window_id = y.window_id AND x.channel_idx = y.channel_idx AND x.half = 1 AND y.half = 2")
    c.add("period", "SELECT cast(4 * power(cast(60 AS double), cast(k AS double) / 31) AS double) AS p, k FROM (SELECT $SEQ(0, 31) AS k) q")
    q("f7_period_independence", "SELECT a.k AS k1, b.k AS k2, abs(1 / a.p - 1 / b.p) * 720 >= 0.5 AND NOT (greatest(a.p / b.p, b.p / a.p) >= 1.5 AND abs(greatest(a.p / b.p, b.p / a.p) / least(greatest(round(greatest(a.p / b.p, b.p / a.p)), 2), 8) - 1) <= 0.05) AS independent FROM period a JOIN period b ON a.k < b.k")
    c.add("tail", "SELECT window_id, channel_idx, regr_slope(value, cast(t AS double)) AS b, regr_intercept(value, cast(t AS double)) AS a FROM hist WHERE t >= origin - least(origin, greatest(16, least(256, floor(origin / 2)))) GROUP BY window_id, channel_idx")
    q("f8_tail_extrapolation", "SELECT s.window_id, s.channel_idx, s.step, $EXACT(t.a + t.b * (s.origin + s.step)) AS value FROM steps s JOIN tail t ON s.window_id = t.window_id AND s.channel_idx = t.channel_idx")

    q("f9_trend_direction", "SELECT window_id, channel_idx, $EXACT(whole) AS slope, cast(dir AS bigint) AS direction FROM trend_sign")
    c.add("lagged", "SELECT y.window_id, y.channel_idx AS responder, x.channel_idx AS driver, y.lag, y.z, y.own, x.z AS drive FROM (SELECT *, $SEQ(1, least(24, greatest(1, floor(origin / 8)))) AS lag FROM (SELECT *, lag(z) OVER (PARTITION BY window_id, channel_idx ORDER BY t) AS own FROM zscore) q) y JOIN zscore x ON x.window_id = y.window_id AND x.channel_idx <> y.channel_idx AND x.t = y.t - y.lag")
    c.add("zscore", "SELECT p.window_id, p.origin, p.channel_idx, p.t, (p.value - s.center) / s.scale AS z FROM hist p JOIN channel_scale s ON p.window_id = s.window_id AND p.channel_idx = s.channel_idx")
    c.add("moments", "SELECT window_id, responder, driver, lag, count(*) AS n, covar_pop(z, own) AS zo, covar_pop(z, drive) AS zd, covar_pop(own, drive) AS od, var_pop(own) AS oo, var_pop(drive) AS dd, var_pop(z) AS zz FROM lagged WHERE own IS NOT NULL GROUP BY window_id, responder, driver, lag")
    c.add("gain", "SELECT window_id, responder, driver, lag, (zd * oo - zo * od) / nullif(oo * dd - od * od, 0) AS beta, 1 - (zz - (zo * (zo * dd - zd * od) + zd * (zd * oo - zo * od)) / nullif(oo * dd - od * od, 0)) / nullif(zz - zo * zo / nullif(oo, 0), 0) AS gain FROM moments")
    q("f12_directed_regression", "SELECT window_id, responder, driver, lag, $EXACT(beta) AS beta, $EXACT(gain) AS gain, gain >= 0.0025 AS accepted FROM gain")
    c.add("ar_pair", "SELECT window_id, channel_idx, z, lag(z) OVER (PARTITION BY window_id, channel_idx ORDER BY t) AS z1 FROM zscore")
    q("f13_autoregression", "SELECT window_id, channel_idx, $EXACT(regr_slope(z, z1)) AS b, $EXACT(regr_intercept(z, z1)) AS a, $EXACT(covar_pop(z - z1, z1 * abs(z1) / (1 + abs(z1)))) AS response_cov FROM ar_pair WHERE z1 IS NOT NULL GROUP BY window_id, channel_idx")
    q("f14_blocked_holdout", "SELECT window_id, channel_idx, count(CASE WHEN held THEN 1 END) AS held_cells, $EXACT(avg(CASE WHEN held THEN value END) - avg(CASE WHEN NOT held THEN value END)) AS shift FROM (SELECT window_id, channel_idx, value, t >= origin - greatest(24, floor(origin / 4)) AS held FROM hist) q GROUP BY window_id, channel_idx")
    q("f15_block_bootstrap", "SELECT q.window_id, q.channel_idx, q.step, $EXACT(q.e - avg(q.e) OVER (PARTITION BY q.window_id, q.channel_idx, q.step)) AS innovation, q.path FROM (SELECT d.window_id, d.channel_idx, d.step, d.path, r.r AS e FROM (SELECT s.window_id, s.channel_idx, s.step, s.path, (cast(floor($U(concat(s.window_id, '|', cast(s.path AS string), '|', cast(cast(floor(s.step / 7) AS bigint) AS string))) * s.origin) AS bigint) + s.step % 7) % s.origin AS at_ FROM (SELECT *, $SEQ(0, 127) AS path FROM steps) s) d JOIN residual r ON r.window_id = d.window_id AND r.channel_idx = d.channel_idx AND r.t = d.at_) q")
    q("f18_impulse_convolution", "SELECT w.window_id, i.level, s.step, $EXACT(sum(i.v * exp(-ln(2.0) * (w.origin + s.step - i.t) / 12.0))) AS response FROM win w JOIN (SELECT DISTINCT window_id, step FROM fut) s ON w.window_id = s.window_id JOIN profile i ON i.window_id = w.window_id AND i.capability_id = 'predictable_intermittency' AND i.t <= w.origin + s.step AND i.t > w.origin + s.step - 48 GROUP BY w.window_id, i.level, s.step")


def perturbations(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    part = "SELECT window_id, level, t, $EXACT(v) AS profile FROM profile WHERE capability_id = '{}'"
    q("p0_loadings", "SELECT window_id, capability_id, channel_idx, cast(dir AS bigint) AS direction, $EXACT(scale) AS amplitude FROM loading")
    q("p1_trend", part.format("trend"))
    q("p1_trend_profiles", "SELECT window_id, t, $EXACT(rel) AS linear, $EXACT(greatest(0, t - 0.25 * (origin - 1)) / (origin - 1)) AS delayed, $EXACT(power(rel, 1.2)) AS curved, $EXACT(coalesce(sum(step) OVER (PARTITION BY window_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS piecewise FROM (SELECT w.window_id, w.origin, p.t, cast(p.t AS double) / (w.origin - 1) AS rel, CASE floor((p.t + 5) / 40) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END / cast(w.origin - 1 AS double) AS step FROM win w JOIN panel p ON p.dataset = w.dataset AND p.channel_idx = 0 AND p.t < w.origin + w.h) q")
    q("p4_regime_switching", part.format("regime_switching"))
    q("p4_regime_profiles", "SELECT window_id, t, $EXACT(p) AS ramp, $EXACT(p * p * (3 - 2 * p)) AS smooth, CASE WHEN p > 0 THEN 1 ELSE 0 END AS step FROM (SELECT w.window_id, p.t, least(greatest((p.t - floor(0.6 * w.origin)) / cast(24 AS double), 0), 1) AS p FROM win w JOIN panel p ON p.dataset = w.dataset AND p.channel_idx = 0 AND p.t < w.origin + w.h) q")
    q("p6_predictable_intermittency", part.format("predictable_intermittency"))
    q("p6_pulse_weights", "SELECT width, i, $EXACT(1.0) AS rectangular, $EXACT(1 - abs(i - (width - 1) / 2.0) / greatest(1, (width - 1) / 2.0 + 1)) AS triangular, $EXACT(exp(-ln(2) * i / greatest(1, width / 2.0))) AS decay FROM (SELECT width, $SEQ(0, width - 1) AS i FROM (VALUES (1), (2), (3), (5)) AS v(width)) q")
    q("p8_hierarchical_coherence", "SELECT window_id, 'hierarchical_coherence' AS capability_id, false AS available, 'qualification_only_no_generation' AS reason FROM win")
    q("p9_cross_series", "SELECT g.window_id, g.responder, g.driver, g.lag, y.t, $EXACT(s.scale * g.beta * x.z) AS unit FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(gain, 9) DESC, responder, driver, lag) AS place FROM gain) g JOIN zscore y ON y.window_id = g.window_id AND y.channel_idx = g.responder JOIN zscore x ON x.window_id = g.window_id AND x.channel_idx = g.driver AND x.t = y.t - g.lag JOIN channel_scale s ON s.window_id = g.window_id AND s.channel_idx = g.responder WHERE g.place = 1")
    q("p10_impulse_kernels", "SELECT i, $EXACT(exp(-ln(2) * i / 12.0)) AS exponential, $EXACT(i / 12.0 * exp(1 - i / 12.0)) AS delayed_gamma, $EXACT(greatest(0, 1 - i / 24.0)) AS triangular FROM (SELECT $SEQ(0, 48) AS i) q")
    q("p11_strength_scaling", "SELECT window_id, capability_id, level, $EXACT(coordinate) AS coordinate, $EXACT(gain) AS gain FROM treatment")
    q("p12_contract_replay", "SELECT t.window_id, t.capability_id, t.level, u.channel_idx, u.step, $EXACT(f.value + t.gain * u.unit) AS treated FROM treatment t JOIN unit_cell u ON t.window_id = u.window_id AND t.capability_id = u.capability_id AND t.level = u.level JOIN fut f ON f.window_id = u.window_id AND f.channel_idx = u.channel_idx AND f.step = u.step")
    q("p13_availability", "SELECT window_id, capability_id, available, coalesce(reason, '') AS reason, CASE WHEN available THEN 5 ELSE 0 END AS levels FROM group_state")
    q("p14_sample_rows", "SELECT concat(window_id, '__baseline') AS sample_id, 'official_baseline' AS evaluation_table, cast(NULL AS string) AS capability_id, cast(0 AS bigint) AS level FROM win UNION ALL SELECT concat(t.window_id, '__', t.capability_id, '__level', cast(t.level AS string), '__aug0__treatment'), 'capability_treatment', t.capability_id, cast(t.level AS bigint) FROM treatment t JOIN group_state g ON t.window_id = g.window_id AND t.capability_id = g.capability_id AND g.available")
    # The assessed channel is the affected one with the largest loading; its siblings are taken away.
    c.add("ablation_plan", "SELECT window_id, capability_id, max(d) AS d, $GET($LIST(channel_idx, (-scale, channel_idx)), 0) AS assessed FROM loading GROUP BY window_id, capability_id")
    q("p15_input_ablation", "SELECT window_id, capability_id, d, assessed, cast($SIZE($KEEP($RANGE(d), i, i <> assessed)) AS bigint) AS removed, $GET($KEEP($RANGE(d), i, i <> assessed), 0) AS first_removed FROM ablation_plan WHERE d > 1")
    q("p16_legacy_shift", "SELECT window_id, channel_idx, t, $EXACT(value) AS source, $EXACT(shifted) AS shifted FROM (SELECT a.window_id, a.channel_idx, a.t, a.value, b.value AS shifted FROM hist a JOIN hist b ON a.window_id = b.window_id AND a.channel_idx = b.channel_idx AND b.t = (a.t + floor(a.origin / 2)) % a.origin) q")


def validation(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    c.add("contract", """SELECT concat(t.window_id, '__', t.capability_id, '__level', cast(t.level AS string), '__aug0__treatment') AS sample_id, t.window_id, t.capability_id, t.level, t.gain, t.coordinate, g.min_macro, g.max_macro, g.max_channel, s.rms,
        CASE WHEN $U(concat(t.window_id, t.capability_id, cast(t.level AS string), 'c')) < 0.1 THEN 'broken' ELSE 'v1' END AS artifact_schema, CASE WHEN $U(concat(t.window_id, t.capability_id, cast(t.level AS string), 'd')) < 0.1 THEN g.min_macro + 0.01 ELSE g.min_macro END AS stored_macro,
        CASE WHEN $U(concat(t.window_id, t.capability_id, cast(t.level AS string), 'e')) < 0.1 THEN 'scored' ELSE coalesce(s.reason, 'scored') END AS stored_status, coalesce(s.reason, 'scored') AS status, t.level + CASE WHEN $U(concat(t.window_id, t.capability_id, cast(t.level AS string), 'f')) < 0.05 THEN 1 ELSE 0 END AS stored_level
        FROM treatment t JOIN distance_gate g ON t.window_id = g.window_id AND t.capability_id = g.capability_id AND t.level = g.level JOIN scoring s ON t.window_id = s.window_id AND t.capability_id = s.capability_id AND t.level = s.level""")
    c.add("rules", """SELECT sample_id, capability_id, CASE WHEN artifact_schema <> 'v1' THEN 'structural_schema_invalid' END AS r1, CASE WHEN abs(stored_macro - min_macro) > 1e-9 * greatest(abs(stored_macro), abs(min_macro)) + 1e-12 THEN 'macro_distance_mismatch' WHEN min_macro < 0.10 - 1e-12 THEN 'below_minimum_model_context_macro_distance' WHEN max_macro > 2.0 + 1e-12 THEN 'above_maximum_model_context_macro_distance' WHEN max_channel > 3.0 + 1e-12 THEN 'above_maximum_model_context_channel_distance' END AS r2,
        CASE WHEN stored_level <> level THEN 'level_mismatch' END AS r3, cast(NULL AS string) AS r4, CASE WHEN rms IS NULL THEN 'horizon_support_missing' END AS r5, CASE WHEN stored_status <> status THEN 'scoring_gate_status_mismatch' END AS r6 FROM contract""")
    q("v1_structure", "SELECT sample_id, r1 AS reason FROM rules")
    q("v2_distance", "SELECT sample_id, r2 AS reason FROM rules")
    q("v3_level", "SELECT sample_id, r3 AS reason FROM rules")
    q("v4_identifiability", "SELECT window_id, channel_idx, coalesce(CASE WHEN n < 48 THEN 'history_too_short_for_holdout' WHEN held < 24 THEN 'holdout_too_short' WHEN abs(b) >= 0.98 THEN 'autoregression_not_stable' END, 'identifiable') AS reason FROM (SELECT a.window_id, a.channel_idx, count(*) AS n, count(*) - cast(floor(count(*) * 0.75) AS bigint) AS held, regr_slope(a.z, a.z1) AS b FROM ar_pair a WHERE a.z1 IS NOT NULL GROUP BY a.window_id, a.channel_idx) q")
    q("v5_horizon", "SELECT sample_id, r5 AS reason FROM rules")
    q("v6_scoring", "SELECT sample_id, r6 AS reason FROM rules")
    c.add("verdict", "SELECT sample_id, capability_id, coalesce(r1, r2, r3, r4, r5, r6) AS reason FROM rules")
    q("v7_first_failure", "SELECT sample_id, reason FROM verdict")
    q("v8_research_validation", "SELECT capability_id, count(*) AS contracts, count(reason) AS failures FROM verdict GROUP BY capability_id")
    q("v8_failure_list", "SELECT sample_id, reason FROM verdict WHERE reason IS NOT NULL ORDER BY sample_id LIMIT 100")
    c.add("expected", "SELECT sample_id, $SHA(concat(capability_id, '|', cast(level AS string))) AS digest FROM contract")
    c.add("actual", "SELECT sample_id, CASE WHEN artifact_schema = 'broken' THEN 'x' ELSE $SHA(concat(capability_id, '|', cast(level AS string))) END AS digest FROM contract WHERE stored_level = level UNION ALL SELECT concat(sample_id, '__stray'), 'x' FROM contract WHERE stored_level <> level")
    q("v9_publication_validation", "SELECT coalesce(e.sample_id, a.sample_id) AS sample_id, CASE WHEN a.sample_id IS NULL THEN 'missing' WHEN e.sample_id IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM expected e FULL OUTER JOIN actual a ON e.sample_id = a.sample_id WHERE a.sample_id IS NULL OR e.sample_id IS NULL OR a.digest <> e.digest")


def adaptation(c: Catalog) -> None:
    q = lambda name, sql: c.add(name, sql, query=True)
    # Limits of the models.
    c.add("catalog", """SELECT * FROM (VALUES ('Timer-4.0', 8192, 960, 960, cast(NULL AS int), cast(NULL AS int), true, false), ('Timer-3.5', 11520, NULL, NULL, 1, 0, false, false), ('Chronos-2', 8192, 1024, 1024, NULL, NULL, true, false), ('moirai2', NULL, NULL, NULL, 1, 0, false, false),
        ('toto2.0', NULL, NULL, NULL, NULL, 0, false, false), ('timesfm2.5', 15360, 1024, 1024, 1, NULL, true, true), ('tirex2', 2048, 320, 320, NULL, NULL, true, false)) AS v(model_id, max_input, max_output, max_future, max_targets, max_covariates, future_covariates, paired)""")
    c.add("shape", "SELECT w.window_id, w.dataset, w.w, w.origin AS context_length, w.h AS horizon, k.d AS target_dim, x.covariate_dim, x.future_dim FROM win w JOIN (SELECT dataset, count(*) AS d FROM chan GROUP BY dataset) k ON w.dataset = k.dataset CROSS JOIN (VALUES (0, 0), (2, 0), (2, 2), (3, 1)) AS x(covariate_dim, future_dim)")
    q("i1_model_catalog", "SELECT model_id, max_input, max_output, max_targets, max_covariates, future_covariates, paired FROM catalog")
    q("i2_input_capability", "SELECT model_id, coalesce(max_targets, -1) AS raw_targets, nullif(coalesce(max_targets, -1), -1) AS max_targets, coalesce(max_covariates, -1) <> 0 AS supports_history_covariates FROM catalog")
    c.add("support", "SELECT s.*, m.model_id, m.max_targets, m.max_covariates, m.future_covariates, m.paired, m.max_future, (m.max_output IS NULL OR s.horizon <= m.max_output) AS window_ok FROM shape s CROSS JOIN catalog m")
    q("i3_support", "SELECT window_id, covariate_dim, future_dim, model_id, window_ok, window_ok AND (max_targets IS NULL OR target_dim <= max_targets) AND (covariate_dim = 0 OR max_covariates IS NULL OR covariate_dim <= max_covariates) AND (future_dim = 0 OR future_covariates) AS sample_ok FROM support")
    c.add("adapted", """SELECT *, CASE WHEN max_targets IS NOT NULL AND target_dim > max_targets THEN 'independent_univariate' WHEN target_dim = 1 THEN 'native_univariate' ELSE 'native_multivariate' END AS target_mode, CASE WHEN covariate_dim = 0 THEN 'none' WHEN NOT covariates_native THEN 'omitted_unsupported' WHEN paired_only THEN 'paired_known_future_only' WHEN future_dim > 0 THEN 'native_known_future' ELSE 'native_history_only' END AS covariate_mode FROM (
        SELECT *, (max_covariates IS NULL OR CASE WHEN paired_only THEN future_dim ELSE covariate_dim END <= max_covariates) AND (future_dim = 0 OR (future_covariates AND (max_future IS NULL OR horizon <= max_future))) AND NOT (covariate_dim > 0 AND paired AND future_dim = 0) AS covariates_native FROM (SELECT *, paired AND future_dim > 0 AND future_dim < covariate_dim AS paired_only FROM support WHERE window_ok) q) q""")
    q("i4_adaptation_plan", "SELECT window_id, covariate_dim, future_dim, model_id, target_mode, covariate_mode, target_mode = 'independent_univariate' OR paired_only OR covariate_mode = 'omitted_unsupported' AS adapted FROM adapted")
    c.add("child", "SELECT window_id, w, model_id, covariate_dim, future_dim, context_length, horizon, CASE WHEN target_mode = 'independent_univariate' THEN 1 ELSE target_dim END AS d, CASE WHEN covariate_mode IN ('none', 'omitted_unsupported') THEN 0 WHEN paired_only THEN future_dim ELSE covariate_dim END AS k, $SEQ(0, CASE WHEN target_mode = 'independent_univariate' THEN target_dim - 1 ELSE 0 END) AS request FROM adapted")
    q("i5_child_requests", "SELECT window_id, model_id, covariate_dim, future_dim, request, cast(d AS bigint) AS d, cast(k AS bigint) AS k FROM child")
    q("i6_shape_groups", "SELECT model_id, concat('C', cast(context_length AS string), '_H', cast(horizon AS string), '_D', cast(d AS string), '_K', cast(k AS string)) AS label, count(*) AS requests FROM child GROUP BY model_id, context_length, horizon, d, k")
    c.add("cost", "SELECT *, cast(context_length * (d + k) + horizon * k AS bigint) AS tokens FROM child")
    q("i7_token_cost", "SELECT model_id, window_id, covariate_dim, future_dim, request, tokens, cast(tokens + horizon * d AS bigint) AS scheduled FROM cost")
    # Requests of a batch have one shape, hence one cost, so bounds on rows, tokens and bytes are one bound on rows.
    q("i8_micro_batches", "SELECT model_id, batch, context_length, d, k, count(*) AS rows_, cast(sum(tokens) AS bigint) AS tokens, cast(sum(tokens) * 4 AS bigint) AS bytes FROM (SELECT *, cast(floor((row_number() OVER (PARTITION BY model_id, context_length, horizon, d, k ORDER BY window_id, covariate_dim, future_dim, request) - 1) / most) AS bigint) AS batch FROM (SELECT *, greatest(1, least(8, cast(floor(65536.0 / tokens) AS bigint), cast(floor(131072.0 / (4 * tokens)) AS bigint))) AS most FROM cost) q) q GROUP BY model_id, batch, context_length, d, k")
    q("i9_adaptation_summary", "SELECT model_id, target_mode, covariate_mode, count(*) AS samples FROM adapted GROUP BY model_id, target_mode, covariate_mode")
    q("i10_preflight", "SELECT m.model_id, max(w.h) AS horizon, bool_and(m.max_output IS NULL OR w.h <= m.max_output) AS horizon_ok, max(least(w.origin, coalesce(m.max_input, w.origin))) AS context_used FROM win w CROSS JOIN catalog m GROUP BY m.model_id")
    q("i11_storage_preflight", "SELECT dataset, cast(count(*) * 51 AS bigint) AS max_views, cast(sum(h) * 51 * 4 * max(d) AS bigint) AS prediction_bytes FROM (SELECT w.dataset, w.h, k.d FROM win w JOIN (SELECT dataset, count(*) AS d FROM chan GROUP BY dataset) k ON w.dataset = k.dataset) q GROUP BY dataset")
    q("i12_shard_size", "SELECT dataset, cast(least(64, ceil(count(*) / 3.0)) AS bigint) AS shard_size FROM win GROUP BY dataset")
    q("i13_shard_assignment", "SELECT window_id, cast(floor(ord / 3) AS bigint) AS shard, cast(floor(ord / 3) AS bigint) % 4 AS worker FROM (SELECT window_id, row_number() OVER (ORDER BY dataset, w) - 1 AS ord FROM win) q")
    q("i14_model_contracts", "SELECT model_id, least(coalesce(max_input, 16384), 16384) AS max_context, coalesce(max_output, 960) >= 720 AS admits_720 FROM catalog")
    q("i15_resume", "SELECT p.model_id, p.dataset FROM (SELECT m.model_id, t.dataset FROM model m CROSS JOIN task t) p LEFT JOIN (SELECT DISTINCT model_id, dataset FROM accuracy WHERE dataset = 'events_hourly' AND model_id <> 'drift') d ON p.model_id = d.model_id AND p.dataset = d.dataset WHERE d.model_id IS NULL")
    for name in ("naive", "seasonal_naive", "drift", "mean", "moving_average", "ols_trend", "panel_blend", "panel_naive"):
        q(f"m3_{name}", f"SELECT window_id, channel_idx, step, $EXACT(yhat) AS yhat FROM fcst WHERE model_id = '{name}'")
    q("m4_recombination", "SELECT model_id, window_id, step, cast($SIZE(row_) AS bigint) AS d, $EXACT($GET(row_, 0)) AS first_, $EXACT($GET(row_, d - 1)) AS last_ FROM (SELECT model_id, window_id, step, cast(count(*) AS int) AS d, $LIST(yhat, channel_idx) AS row_ FROM fcst GROUP BY model_id, window_id, step) q")
    q("m6_status", "SELECT model_id, cast(sum(views) AS bigint) AS views, max(worker) AS last_worker, bool_and(views > 0) AS complete, count(*) = count(DISTINCT worker) AS disjoint FROM (SELECT model_id, window_id AS worker, count(*) AS views FROM fcst GROUP BY model_id, window_id) q GROUP BY model_id")
