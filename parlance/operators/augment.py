"""Augmentation of sound samples: gain, noise, resampling, band limits, reverb, soft clipping and dropouts, drawn per row.

What happens to a row depends on its own seed only, so results don't change with the partitioning and a task that runs again gives the same. Samples travel in
Arrow batches; a function of (samples, rate, rng) can be put in place of the profiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import stable_seed

Change = Callable[[np.ndarray, int, np.random.Generator], np.ndarray]

#: Fixed values of the profiles: the chance of each change, and the ranges that its values are drawn from.
PROFILES = {
    "light": [("gain", 1.0, {"decibel": (-2.5, 2.5)}), ("noise", 0.55, {"snr": (18.0, 28.0)}), ("band", 0.35, {"low": (50.0, 120.0), "high": (3600.0, 7000.0)}), ("reverb", 0.15, {})],
    "heavy": [
        ("gain", 1.0, {"decibel": (-5.0, 4.0)}), ("noise", 0.8, {"snr": (10.0, 24.0)}), ("resample", 0.85, {"rates": (8000, 12000)}), ("band", 0.7, {"low": (70.0, 180.0), "high": (2600.0, 5200.0)}),
        ("reverb", 0.25, {}), ("clip", 0.45, {"drive": (1.2, 2.4)}), ("dropout", 0.3, {"bursts": (1, 3)}),
    ],
}


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0


def gain(x, rate, rng, decibel):
    return x * 10 ** (rng.uniform(*decibel) / 20)


def noise(x, rate, rng, snr):
    return x + rng.normal(0.0, max(rms(x), 1e-6) / 10 ** (rng.uniform(*snr) / 20), len(x))


def band(x, rate, rng, low, high):
    """Frequencies outside the band are taken out; fewer than 32 samples have none to speak of."""
    lo, hi = rng.uniform(*low), rng.uniform(*high)
    if len(x) < 32:
        return x
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.where((hz >= lo) & (hz <= hi), np.fft.rfft(x), 0), len(x))


def resample(x, rate, rng, rates):
    """Down to one of the rates and back, by straight lines."""
    to = int(rng.choice(rates))
    n = max(8, round(len(x) / rate * to))
    if len(x) < 8 or to == rate or n == len(x):
        return x
    fine, coarse = np.linspace(0, 1, len(x)), np.linspace(0, 1, n)
    return np.interp(fine, coarse, np.interp(coarse, fine, x))


def reverb(x, rate, rng):
    """A decaying echo of up to 30 ms, mixed in."""
    if len(x) < 64:
        return x
    n = min(max(int(0.03 * rate), 32), max(len(x) // 2, 32))
    echo = np.exp(-rng.uniform(18.0, 45.0) * np.arange(n) / rate) * rng.uniform(0.08, 0.22) * rng.uniform(0.6, 1.4, n)
    echo[0] = 1.0
    dry = rng.uniform(0.78, 0.92)
    size = len(x) + n - 1
    return dry * x + (1 - dry) * np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(echo, size), size)[: len(x)]


def clip(x, rate, rng, drive):
    d = rng.uniform(*drive)
    return np.tanh(x * d) / np.tanh(d)


def dropout(x, rate, rng, bursts):
    """Short stretches that nearly vanish."""
    x = x.copy()
    for _ in range(int(rng.integers(bursts[0], bursts[1] + 1)) if len(x) >= 128 else 0):
        n = max(8, int(rate * rng.uniform(0.006, 0.03)))
        if n < len(x):
            at = int(rng.integers(0, len(x) - n))
            x[at : at + n] *= rng.uniform(0.0, 0.25)
    return x


CHANGES = {f.__name__: f for f in (gain, noise, band, resample, reverb, clip, dropout)}


def augmented(x: np.ndarray, rate: int, seed: int, profile: str) -> np.ndarray:
    """One waveform under a profile; one that comes out silent or not finite stays as it was. The peak grows by a twentieth at most."""
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    out = x.astype(np.float64)
    for name, chance, ranges in PROFILES[profile]:
        if rng.random() < chance:
            out = CHANGES[name](out, rate, rng, **ranges)
    top = float(np.abs(out).max()) if len(out) else 0.0
    if not len(x) or not np.isfinite(out).all() or rms(out) <= 1e-7 or top <= 1e-8:
        return x.astype(np.float32)
    peak = min(0.98, 1.05 * max(float(np.abs(x).max()), 1e-3))
    return (out * min(peak / top, 1.5)).astype(np.float32)


def augment(rows: DataFrame, seed: Column, profile: str | None = None, change: Change | None = None) -> DataFrame:
    """rows (sample_rate, samples, ...) with the samples changed: by a profile, or by one's own function. Null samples stay null, `none` changes nothing."""
    if change is None and profile in (None, "", "none", "off", "disabled"):
        return rows
    if change is None and profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}, but {', '.join(PROFILES)}")

    @F.pandas_udf("array<float>")
    def run(samples: pd.Series, rate: pd.Series, seeds: pd.Series) -> pd.Series:
        def one(x, hz, s):
            if x is None:
                return None
            x = np.asarray(x, np.float32)
            return augmented(x, int(hz), int(s), profile) if change is None else change(x, int(hz), np.random.default_rng(int(s) & 0xFFFFFFFFFFFFFFFF)).astype(np.float32)

        return pd.Series([one(*r) for r in zip(samples, rate, seeds, strict=True)], index=samples.index, dtype=object)

    return rows.withColumn("samples", run(F.col("samples").cast("array<float>"), "sample_rate", seed))


def augmented_passes(windows: DataFrame, keys: list[str], profile: str, copies: int, seed: int = 13) -> DataFrame:
    """windows (sample_rate, samples, ...) as they are in pass 0, and `copies` times augmented in passes 1, 2, ...; with pass_index and the seed of each row."""
    out = windows.withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    out = out.withColumn("seed", stable_seed(F.lit(str(seed)), F.lit(profile), *[F.col(k).cast("string") for k in keys], F.col("pass_index").cast("string")))
    changed = augment(out.where("pass_index > 0"), F.col("seed"), profile)
    return out.where("pass_index = 0").unionByName(changed.select(out.columns))
