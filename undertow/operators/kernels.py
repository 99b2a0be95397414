"""Numerical kernels for the capabilities that SQL can't express, one window at a time.

A window comes as rows (window_id, channel_idx, t, value) of its history. A kernel gets the history as an array
[L, D] and returns a unit component [L + H, D], or raises Unavailable with a reason. Groups are windows, whose
size is the context length times the channels, so no task holds more than one window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from undertow.functions.seeds import generator


class Unavailable(ValueError):
    """Why a window doesn't support a capability."""


def scales(history: np.ndarray) -> np.ndarray:
    """Population deviation of each channel, else that of its differences, else 1."""
    sd, step = history.std(axis=0), np.diff(history, axis=0).std(axis=0)
    return np.where(sd > 1e-8, sd, np.where(step > 1e-8, step, 1.0))


def detrend(x: np.ndarray) -> np.ndarray:
    line = np.linspace(-1.0, 1.0, len(x))
    design = np.column_stack([np.ones_like(line), line])
    return x - design @ np.linalg.lstsq(design, x, rcond=None)[0]


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins from 2 to a quarter of the length and their spectral power; none for short series."""
    n = len(x)
    if n < 24:
        return np.empty(0, int), np.empty(0)
    power = np.abs(np.fft.rfft(detrend(x) * np.hanning(n))) ** 2
    bins = np.arange(2, n // 4 + 1)
    return bins, power[bins]


def dominant_bins(x: np.ndarray, most: int = 16) -> np.ndarray:
    """Bins of the largest spectral power, from 2 to a quarter of the length; none for short series."""
    bins, power = spectrum(x)
    return bins[np.argsort(-power, kind="stable")[:most]]


def harmonic_fit(x: np.ndarray, period: float) -> tuple[float, float]:
    """Sine and cosine amplitudes by least squares, without intercept."""
    t = 2 * np.pi * np.arange(len(x)) / period
    return tuple(np.linalg.lstsq(np.column_stack([np.sin(t), np.cos(t)]), x, rcond=None)[0])


def independent(p: float, q: float, length: int) -> bool:
    """Whether two periods part by half a cycle over the length and are no near integer ratio of each other."""
    ratio = max(p / q, q / p)
    near = any(abs(ratio / k - 1) <= 0.05 for k in range(2, 9))
    return abs(1 / p - 1 / q) * length >= 0.5 and not near


def multi_seasonal(history: np.ndarray, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """An anchor period of the data and up to five independent ones, for one channel each scaled to its deviation."""
    length, sd = len(history), scales(history)
    top = min(length / 3, horizon / 0.5)
    if top <= 4:
        raise Unavailable("history_or_horizon_too_short_for_seasonal_periods")
    anchors = []
    for bin_ in dominant_bins(history[:, 0])[:3]:
        period = length / bin_
        half = length // 2
        a, b = (np.array(harmonic_fit(detrend(h), period)) for h in (history[:half, 0], history[half : 2 * half, 0]))
        size = np.hypot(*a), np.hypot(*b)
        shift = 2 * np.pi * half / period
        b = np.array([b[0] * np.cos(shift) + b[1] * np.sin(shift), b[1] * np.cos(shift) - b[0] * np.sin(shift)])
        if min(size) > 0 and a @ b / (size[0] * size[1]) >= 0.5 and min(size) / max(size) >= 0.5 and min(size) >= 0.05 * sd[0]:
            anchors.append(period)
    if not anchors:
        raise Unavailable("no_stable_seasonal_anchor")
    chosen = [anchors[rng.integers(len(anchors))]]
    for period in rng.permutation(np.geomspace(4, top, 512)):
        if len(chosen) == 6:
            break
        if all(independent(period, p, length) for p in chosen):
            chosen.append(float(period))
    t = np.arange(length + horizon)[:, None]
    parts = [np.sqrt(2) * sd * np.sin(2 * np.pi * t / p + rng.uniform(0, 2 * np.pi)) for p in chosen]
    total = np.sum(parts, axis=0)
    return total / np.maximum(total[:length].std(axis=0), 1e-12) * sd


def time_varying_seasonality(history: np.ndarray, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """A carrier of the data times a slow envelope, by amplitude or by phase, where that explains the residual."""
    length, sd = len(history), scales(history)
    x = detrend(history[:, 0])
    pool = []
    for carrier in dominant_bins(history[:, 0])[:4]:
        a, b = harmonic_fit(x, length / carrier)
        angle = 2 * np.pi * np.arange(length + horizon) * carrier / length
        wave, quadrature = a * np.sin(angle) + b * np.cos(angle), a * np.cos(angle) - b * np.sin(angle)
        rest = x - wave[:length]
        for base in (wave, quadrature):
            for index in range(2, min(16, (carrier - 1) // 2) + 1):
                slow = 2 * np.pi * index * np.arange(length + horizon) / length
                design = np.column_stack([base * np.sin(slow), base * np.cos(slow)])
                weights = np.linalg.lstsq(design[:length], rest, rcond=None)[0]
                fit = design @ weights
                gain = 1 - ((rest - fit[:length]) ** 2).sum() / max((rest**2).sum(), 1e-12)
                envelope = np.abs(weights[0] * np.sin(slow) + weights[1] * np.cos(slow))
                active = (envelope[length:] >= 0.25 * max(envelope.max(), 1e-12)).mean()
                if gain >= 0.01 and fit[:length].std() >= 0.01 * sd[0] and active >= 0.25:
                    pool.append((gain, len(pool), fit))
    if not pool:
        raise Unavailable("constrained_am_envelope_not_resolved")
    pool.sort(key=lambda p: (-p[0], p[1]))
    pool = [p for p in pool if p[0] >= 0.5 * pool[0][0]][:8]
    fit = pool[rng.integers(len(pool))][2]
    out = np.zeros((length + horizon, history.shape[1]))
    out[:, 0] = fit / max(fit[:length].std(), 1e-12) * sd[0]
    return out


def response(z: np.ndarray) -> np.ndarray:
    return z * np.abs(z) / (1 + np.abs(z))


def block_paths(innovations: np.ndarray, horizon: int, paths: int, rng: np.random.Generator) -> np.ndarray:
    """Circular moving-block bootstrap, [paths, horizon], centred at each step."""
    n = len(innovations)
    block = min(n, max(4, int(np.ceil(np.sqrt(horizon)))))
    starts = rng.integers(0, n, (paths, -(-horizon // block)))
    out = innovations[(starts[:, :, None] + np.arange(block)) % n].reshape(paths, -1)[:, :horizon]
    return out - out.mean(axis=0)


def nonlinear_persistence(history: np.ndarray, horizon: int, rng: np.random.Generator, fraction: float = 0.5, paths: int = 128) -> np.ndarray:
    """What a nonlinear term adds to the first channel's autoregression: the history's recursion with its own
    innovations, then the mean of paired paths."""
    length, sd = len(history), scales(history)
    z = (history[:, 0] - history[:, 0].mean()) / sd[0]
    if length < 64:
        raise Unavailable("history_too_short_for_nonlinear_persistence")
    train = length - max(24, length // 4)
    design = np.column_stack([np.ones(length - 1), z[:-1], response(z[:-1])])
    linear = np.linalg.lstsq(design[:train, :2], z[1 : train + 1], rcond=None)[0]
    full = np.linalg.lstsq(design[:train], z[1 : train + 1], rcond=None)[0]
    held = z[train + 1 :]
    errors = [((held - d @ w) ** 2).sum() for d, w in ((design[train:, :2], linear), (design[train:], full))]
    if 1 - errors[1] / max(errors[0], 1e-12) < 0.005:
        raise Unavailable("nonlinear_gain_not_confirmed_on_holdout")
    a, b = np.linalg.lstsq(design[:, :2], z[1:], rcond=None)[0]
    sign = 1.0 if full[2] >= 0 else -1.0
    c = sign * fraction * max(0.98 - sign * b, 0)
    innovations = z[1:] - a - b * z[:-1]
    treated = z.copy()
    for k in range(1, length):
        treated[k] = np.clip(a + b * treated[k - 1] + c * response(treated[k - 1]) + innovations[k - 1], -8, 8)
    noise = block_paths(innovations, horizon, paths, rng)
    plain, curved, out = np.full(paths, z[-1]), np.full(paths, treated[-1]), np.zeros((length + horizon, history.shape[1]))
    out[:length, 0] = sd[0] * (treated - z)
    for h in range(horizon):
        plain = np.clip(a + b * plain + noise[:, h], -8, 8)
        curved = np.clip(a + b * curved + c * response(curved) + noise[:, h], -8, 8)
        out[length + h, 0] = sd[0] * (curved - plain).mean()
    return out


def common_factor(history: np.ndarray, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """A harmonic of the first principal factor, loaded on every channel."""
    length, d = history.shape
    if d < 3:
        raise Unavailable("common_factor_requires_native_panel_d_ge_3")
    if length < 24:
        raise Unavailable("history_too_short_for_common_factor")
    sd = scales(history)
    z = (history - history.mean(axis=0)) / sd
    u, s, v = np.linalg.svd(z, full_matrices=False)
    if s[0] ** 2 / (s**2).sum() < 1 / d + 0.02:
        raise Unavailable("top_common_factor_share_too_small")
    loading = v[0] * np.sign(v[0][np.argmax(np.abs(v[0]))])
    factor = z @ loading
    pool = []
    for bin_ in dominant_bins(factor)[:8]:
        a, b = harmonic_fit(factor, length / bin_)
        angle = 2 * np.pi * bin_ * np.arange(length + horizon) / length
        wave = a * np.sin(angle) + b * np.cos(angle)
        thirds = np.array_split(wave[length:], 3)
        head, tail = (np.sqrt((part**2).mean()) if len(part) else 0.0 for part in (thirds[0], thirds[2]))
        share = wave[:length].var() / max(factor.var(), 1e-12)
        if share >= 0.05 and tail >= 0.5 * head:
            pool.append((share, wave))
    if not pool:
        raise Unavailable("no_supported_common_factor_carrier")
    pool.sort(key=lambda p: -p[0])
    wave = pool[rng.integers(min(12, len(pool)))][1]
    return wave[:, None] * (loading * sd)[None, :]


def covariate_impulse_response(history: np.ndarray, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """Impulses on a driver (the last channel), answered by the first through a kernel."""
    length, sd = len(history), scales(history)
    periods = [p for p in (1.5 * horizon, 2 * horizon, 2.5 * horizon) if p >= 8 and length >= 2 * p]
    if history.shape[1] < 2 or not periods:
        raise Unavailable("no_native_dynamic_covariate")
    period, half = periods[rng.integers(len(periods))], horizon * (0.5, 1.0, 1.5)[rng.integers(3)]
    i = np.arange(2 * horizon + 1)
    kernel = (np.exp(-np.log(2) * i / half), i / half * np.exp(1 - i / half), np.maximum(0, 1 - i / (2 * half)))[rng.integers(3)]
    impulses = np.zeros(length + horizon)
    impulses[np.arange(length - 1, -1, -int(round(period)))] = 1.0
    out = np.zeros((length + horizon, history.shape[1]))
    out[:, 0] = sd[0] * np.convolve(impulses, kernel / kernel.max())[: length + horizon]
    return out


def xreg_forecast(history: np.ndarray, covariates: np.ndarray, future: np.ndarray, forecast: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Forecast what covariates leave of a history, and add back what they say of the future."""
    weights = np.linalg.pinv(np.column_stack([np.ones(len(covariates)), covariates])) @ history
    fitted = np.column_stack([np.ones(len(covariates)), covariates]) @ weights
    return forecast(history - fitted) + np.column_stack([np.ones(len(future)), future]) @ weights


CAPABILITIES = {f.__name__: f for f in (multi_seasonal, time_varying_seasonality, nonlinear_persistence, common_factor, covariate_impulse_response)}


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Rows of a window as [L, D]."""
    return pdf.pivot(index="t", columns="channel_idx", values="value").to_numpy(float)


def components(history: DataFrame, capability: str, base_seed: int = 0) -> DataFrame:
    """window_id, capability_id, available, reason, channel_idx, t, unit for the future cells of every window of
    ``history`` (window_id, h, channel_idx, t, value); one row without cells where a window doesn't support it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window, horizon = pdf["window_id"].iloc[0], int(pdf["h"].iloc[0])
        x = matrix(pdf)
        try:
            unit = CAPABILITIES[capability](x, horizon, generator(base_seed, window, capability))[len(x) :]
        except (Unavailable, np.linalg.LinAlgError) as error:
            return pd.DataFrame({"window_id": [window], "capability_id": capability, "available": False, "reason": str(error), "channel_idx": [None], "step": [None], "unit": [None]})
        step, channel = np.indices(unit.shape)
        return pd.DataFrame({"window_id": window, "capability_id": capability, "available": True, "reason": None, "channel_idx": channel.ravel(), "step": step.ravel(), "unit": unit.ravel()})

    return history.select("window_id", "h", "channel_idx", "t", "value").groupBy("window_id").applyInPandas(run, "window_id string, capability_id string, available boolean, reason string, channel_idx long, step long, unit double")


def powers(history: DataFrame) -> DataFrame:
    """window_id, channel_idx, bin, power: the relation ``power``, by FFT instead of a sum for each bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, power = spectrum(pdf.sort_values("t")["value"].to_numpy(float))
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "channel_idx": pdf["channel_idx"].iloc[0], "bin": bins, "power": power})

    return history.select("window_id", "channel_idx", "t", "value").groupBy("window_id", "channel_idx").applyInPandas(run, "window_id string, channel_idx long, bin long, power double")


def spectra(history: DataFrame) -> DataFrame:
    """window_id, channel_idx, place, bin: the dominant bins of every channel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = dominant_bins(pdf.sort_values("t")["value"].to_numpy(float))
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "channel_idx": pdf["channel_idx"].iloc[0], "place": np.arange(1, len(bins) + 1), "bin": bins})

    return history.select("window_id", "channel_idx", "t", "value").groupBy("window_id", "channel_idx").applyInPandas(run, "window_id string, channel_idx long, place long, bin long")


def factors(history: DataFrame) -> DataFrame:
    """window_id, channel_idx, loading, share: the first factor of every window's standardised panel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf)
        _, s, v = np.linalg.svd((x - x.mean(axis=0)) / scales(x), full_matrices=False)
        load = v[0] * np.sign(v[0][np.argmax(np.abs(v[0]))])
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "channel_idx": np.arange(len(load)), "loading": load, "share": s[0] ** 2 / (s**2).sum()})

    return history.select("window_id", "channel_idx", "t", "value").groupBy("window_id").applyInPandas(run, "window_id string, channel_idx long, loading double, share double")


def forecast(history: DataFrame, model: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """window_id, channel_idx, step, yhat of a model: a function of a history [L] and a horizon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(model(pdf.sort_values("t")["value"].to_numpy(float), int(pdf["h"].iloc[0])), float)
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "channel_idx": pdf["channel_idx"].iloc[0], "step": np.arange(len(y)), "yhat": y})

    return history.select("window_id", "channel_idx", "h", "t", "value").groupBy("window_id", "channel_idx").applyInPandas(run, "window_id string, channel_idx long, step long, yhat double")


def smoothing(x: np.ndarray, horizon: int, alpha: float = 0.3) -> np.ndarray:
    """Simple exponential smoothing."""
    level = x[0]
    for v in x[1:]:
        level += alpha * (v - level)
    return np.full(horizon, level)


def harmonic_regression(x: np.ndarray, horizon: int) -> np.ndarray:
    """A line and the three dominant harmonics."""
    n = len(x)
    t = np.arange(n + horizon)
    columns = [np.ones(n + horizon), t / n] + [f(2 * np.pi * b * t / n) for b in dominant_bins(x)[:3] for f in (np.sin, np.cos)]
    design = np.column_stack(columns)
    return (design @ np.linalg.lstsq(design[:n], x, rcond=None)[0])[n:]
