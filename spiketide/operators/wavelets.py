"""Power of responses along a chirp: a bank of Morlet wavelets, the ridge that follows the chirp, and features of it.

A signal (a histogram of one repeat) is an array in a row; a task holds the banks of a few rows at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _keys

#: Numbers of banks that a task holds at once; one bank at least.
CELLS = 1 << 19

#: Bandwidth and centre frequency of the wavelet; fixed values.
BANDWIDTH, CENTRE = 3.0, 1.5


def bank(signal: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Magnitudes of the wavelet transform, scales x samples: sqrt(scale) times the inverse transform of the signal's spectrum under
    exp(-pi^2 BANDWIDTH (scale f - CENTRE)^2), f in cycles a sample. The signal is padded with zeros to twice its length. Signals may be
    the rows of a matrix, each has its bank then."""
    n = signal.shape[-1]
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.fftfreq(size)
    window = np.exp(-((np.pi * (scales[:, None] * f - CENTRE)) ** 2) * BANDWIDTH) * (f > 0)
    return np.sqrt(scales)[:, None] * np.abs(np.fft.ifft(np.fft.fft(signal, size)[..., None, :] * window, axis=-1)[..., :n])


def ridge(power: np.ndarray, path: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(power along it, shift) of each bank: the path of scale numbers, moved by up to `reach` scales either way, that collects most power; the least
    move of equally good ones, down before up. Places beyond the bank are those at its ends."""
    at, banks = np.arange(power.shape[-1]), np.arange(len(power))
    most, best, trace = np.full(len(power), -np.inf), np.zeros(len(power), int), None
    for shift in sorted(range(-reach, reach + 1), key=lambda s: (abs(s), s)):
        along = np.ascontiguousarray(power[:, np.clip(path + shift, 0, power.shape[1] - 1), at])
        total = along.sum(axis=1)
        better = banks if trace is None else np.flatnonzero(total > most)
        if trace is None:
            trace = along
        most[better], best[better], trace[better] = total[better], shift, along[better]
    return trace, best


def low_pass(rows: np.ndarray, cutoff: float, fs: float, order: int = 10) -> np.ndarray:
    """Butterworth low-pass of even order over the last axis, as second-order sections by the bilinear transform."""
    warped = 2 * fs * math.tan(math.pi * cutoff / fs)
    out = np.array(rows, float)
    for k in range(order // 2):
        pole = warped * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
        z = (2 * fs + pole) / (2 * fs - pole)
        a1, a2 = -2 * z.real, abs(z) ** 2
        gain = (1 + a1 + a2) / 4
        s1 = s2 = np.zeros(out.shape[:-1])
        for t in range(out.shape[-1]):
            x = out[..., t]
            y = gain * x + s1
            s1, s2 = 2 * gain * x - a1 * y + s2, gain * x - a2 * y
            out[..., t] = y
    return out


def chirp_features(signals: DataFrame, by: list[str], values: str, hertz: list[float], fs: float, scales: int = 300, widest: float = 1024.0, reach: int = 150, cutoff: float | None = None, average: int = 400, share: float = 0.2) -> DataFrame:
    """(by..., power_max, frequency, power_ratio, threshold_frequency, threshold_power, shift) of each signal.

    hertz: the chirp's frequency at every bin. The signal less its mean is seen through `scales` wavelets of scale 1 to `widest`, evenly in the logarithm; the
    ridge starts from the scale nearest to the chirp's frequency at each bin. Low-passed (by default below a tenth of fs) its greatest value is power_max,
    at the chirp's `frequency`. Of its running mean over `average` bins, the last place above `share` of power_max gives threshold_frequency
    (where the mean begins) and threshold_power, its sum over 10 places either way. power_ratio: the share of all power before the maximum, by
    threshold_power; null where that is 0. Signals of another length than hertz, or of no variation, have nulls; nulls in them are 0.
    """
    widths = np.geomspace(1, widest, scales)
    centres, chirp = CENTRE * fs / widths, np.array(hertz, float)
    path = np.abs(np.log(centres[:, None] / np.maximum(chirp, 1e-12)[None, :])).argmin(axis=0)
    cut = cutoff or fs / 10
    names = ["power_max", "frequency", "power_ratio", "threshold_frequency", "threshold_power", "shift"]

    size = min(average, len(chirp))
    each = len(widths) << (2 * len(chirp) - 1).bit_length()  # numbers in a bank

    def features(v: np.ndarray) -> list[list]:
        """Of signals of the right length, one to a row, that vary."""
        traces, shifts = ridge(bank(v - v.mean(axis=1, keepdims=True), widths), path, reach)
        smooths = low_pass(traces, cut, fs)
        tops = smooths.argmax(axis=1)
        sums = np.concatenate([np.zeros((len(v), 1)), smooths.cumsum(axis=1)], axis=1)
        means = (sums[:, size:] - sums[:, :-size]) / size
        out = []
        for trace, smooth, mean, top, shift in zip(traces, smooths, means, tops.tolist(), shifts.tolist(), strict=True):
            above = np.flatnonzero(mean > smooth[top] * share)
            last = int(above[-1]) if len(above) else 0
            near = float(mean[max(0, last - 10) : last + 10].sum())
            ratio = float(trace[:top].sum() / near / trace.sum()) if near > 0 else None
            out.append([float(smooth[top]), float(chirp[top]), ratio, float(chirp[last]), near, shift])
        return out

    def run(batches):
        step = max(1, CELLS // each)
        for batch in batches:
            lists = batch.column(len(by))
            places = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == len(chirp))
            flat = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float)
            v = np.nan_to_num(flat).reshape(len(places), len(chirp))
            vary = np.ptp(v, axis=1) != 0 if len(v) else np.zeros(0, bool)
            places, v = places[vary], v[vary]
            rows = [[None] * 6] * len(batch)
            for k in range(0, len(v), step):
                for place, row in zip(places[k : k + step].tolist(), features(v[k : k + step]), strict=True):
                    rows[place] = row
            columns = [pa.array([r[k] for r in rows], pa.int32() if k == 5 else pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *columns], [*by, *names])

    kinds = ", ".join(f"{n} {'int' if n == 'shift' else 'double'}" for n in names)
    return signals.select(*by, F.col(values).cast("array<double>").alias("v")).mapInArrow(run, f"{_keys(signals, by)}, {kinds}")
