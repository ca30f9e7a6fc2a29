"""Column functions: response curves, filter masks and kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, k: float, top: float, x0: float, b: float) -> Column:
    return F.lit(float(top)) / (1 + F.exp(-k * (x - x0))) - b


def softplus(x: Column, a: float, b: float, c: float, d: float, k: float) -> Column:
    return c * F.pow(F.ln(1 + F.exp(a * x + b)), F.lit(float(k))) + d


def bleach(x: Column, a: float, b: float, c: float) -> Column:
    """An exponential decay to a floor."""
    return a * F.exp(-b * x) + c


def log_magnitude(re: Column, im: Column, floor: float = -6000.0) -> Column:
    """20 ln |z|; ``floor`` at 0."""
    return F.coalesce(20 * F.ln(F.nullif(F.sqrt(re * re + im * im), F.lit(0.0))), F.lit(floor))


def notch(u: Column, v: Column, height: int, width: int, du: float, dv: float, d0: float = 9, kind: str = "ideal", order: int = 1) -> Column:
    """A notch pair at +-(du, dv) from the centre of a height by width spectrum: 0 rejects, 1 passes."""
    one = F.sqrt(F.pow(u - height / 2 + du, 2) + F.pow(v - width / 2 + dv, 2))
    two = F.sqrt(F.pow(u - height / 2 - du, 2) + F.pow(v - width / 2 - dv, 2))
    if kind == "gaussian":
        return 1 - F.exp(-0.5 * (one * two / (d0 * d0)))
    if kind == "butter":
        return F.when((one == 0) | (two == 0), 0.0).otherwise(1 / (1 + F.pow(d0 * d0 / (one * two), F.lit(float(order)))))
    return F.when((one <= d0) | (two <= d0), 0.0).otherwise(1.0)


def hamming_window(y: Column, x: Column, height: int, width: int, power: float = 1.0) -> Column:
    """A separable window, the root of the product of both profiles to a power."""
    side = lambda i, n: 0.54 - 0.46 * F.cos(2 * np.pi * i / (n - 1))
    return F.pow(F.sqrt(side(y, height) * side(x, width)), F.lit(float(power)))


def round_odd(x: float) -> int:
    """The nearest odd whole number, 1 at least."""
    return max(1, 2 * int(x // 2) + 1)


def gaussian_kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return (w / w.sum()).tolist()


def savgol_kernel(size: int, order: int, at: int | None = None) -> list[float]:
    """Weights of the value at place ``at`` (the middle) of a least-squares polynomial over ``size`` places."""
    at = size // 2 if at is None else at
    basis = np.vander(np.arange(size) - at, order + 1, increasing=True)
    return np.linalg.pinv(basis)[0].tolist()


def dft(values: Column, n: int) -> Column:
    """The discrete Fourier transform of an array's first n values: an array of structs (re, im)."""
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def part(k: Column, wave, sign: float) -> Column:
        terms = F.transform(places, lambda j: F.get(values, j) * wave(2 * np.pi * ((k * j) % n) / n))
        return sign * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return F.transform(places, lambda k: F.struct(part(k, F.cos, 1.0).alias("re"), part(k, F.sin, -1.0).alias("im")))


def times_conjugate(a: Column, b: Column) -> Column:
    """a times the conjugate of b, structs (re, im)."""
    return F.struct((a["re"] * b["re"] + a["im"] * b["im"]).alias("re"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("im"))
