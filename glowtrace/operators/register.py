"""Registration: each frame against a template by bounded cross-correlation, whole or by patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.operators import project
from glowtrace.operators.images import median_filter
from glowtrace.sources.scratch import checkpointed
from glowtrace.sources.tables import frames_of, pixels_of


#: Templates are broadcast up to this many bytes.
TEMPLATE_BYTES = 64 << 20
#: Fixed value: the slope of the cubic convolution kernel at a distance of one pixel.
SHARPNESS = -0.75


def template_of(frames: DataFrame, **interval) -> DataFrame:
    """(rec_id, template): the mean image of each recording as a row, in a checkpoint."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    rows = project.template(pixels_of(frames), **interval).groupBy("rec_id").agg(F.transform(cells, lambda c: c["v"].cast("double")).alias("template"))
    return checkpointed(frames.sparkSession, rows)


def _beside(frames: DataFrame, templates: DataFrame | dict[str, np.ndarray]) -> DataFrame:
    """frames with their recording's template, broadcast up to a measured size, else by a shuffled join."""
    if isinstance(templates, dict):
        rows = [(rec, t.ravel().astype(float).tolist()) for rec, t in templates.items()]
        templates = frames.sparkSession.createDataFrame(rows, "rec_id string, template array<double>")
    size = templates.agg(F.sum(F.size("template").cast("long") * 8)).first()[0] or 0
    rows = frames.join(F.broadcast(templates) if size <= TEMPLATE_BYTES else templates, "rec_id", "left")
    return rows.select(*frames.columns, F.coalesce("template", F.raise_error(F.concat(F.lit("no template of "), F.coalesce("rec_id", F.lit("null")))).cast("array<double>")).alias("template"))


def best_shift(image: np.ndarray, template: np.ndarray, most: tuple[int, int], centre: tuple[int, int] = (0, 0)) -> tuple[int, int, float]:
    """The circular shift (dy, dx) of the image, within ``most`` of ``centre``, that correlates best with the template; the
    smallest one of equals."""
    a, b = image - image.mean(), template - template.mean()
    surface = np.real(np.fft.ifft2(np.conj(np.fft.fft2(a)) * np.fft.fft2(b)))
    norm = np.sqrt((a * a).sum() * (b * b).sum())
    spans = [range(c - m, c + m + 1) for c, m in zip(centre, most, strict=True)]
    dy, dx = min(((y, x) for y in spans[0] for x in spans[1]), key=lambda s: (-round(surface[s[0] % len(a), s[1] % a.shape[1]], 9), abs(s[0]) + abs(s[1]), s))
    return dy, dx, float(surface[dy % len(a), dx % a.shape[1]] / norm) if norm else 0.0


def waves(size: int, at: np.ndarray) -> np.ndarray:
    """(len(at), size): what each frequency of a row of ``size`` samples adds at fractional places. The middle frequency of an
    even row is a cosine, so real rows stay real between their samples."""
    out = np.exp(2j * np.pi * np.outer(at, np.fft.fftfreq(size)))
    if size % 2 == 0:
        out[:, size // 2] = np.cos(np.pi * at)
    return out


def refined_shift(image: np.ndarray, template: np.ndarray, most: tuple[int, int], upsample: int, centre: tuple[int, int] = (0, 0)) -> tuple[float, float, float]:
    """``best_shift`` to 1 / ``upsample`` of a pixel: the cross-correlation's trigonometric interpolation in a window of three
    quarters of a pixel around the best whole shift, by two small matrix products with the spectrum (Guizar-Sicairos et al.,
    2008). ``most`` bounds it as it does whole shifts; the smallest of equals wins."""
    dy, dx, r = best_shift(image, template, most, centre)
    if upsample == 1:
        return dy, dx, r
    h, w = image.shape
    a, b = image - image.mean(), template - template.mean()
    reach = -(-3 * upsample // 4)
    steps = np.arange(-reach, reach + 1) / upsample
    ys, xs = (at + steps[np.abs(at + steps - c) <= m] for at, c, m in ((dy, centre[0], most[0]), (dx, centre[1], most[1])))
    spectrum = np.conj(np.fft.fft2(a)) * np.fft.fft2(b)
    window = np.real(waves(h, ys) @ spectrum @ waves(w, xs).T) / (h * w)
    norm = np.sqrt((a * a).sum() * (b * b).sum())
    y, x = min(np.ndindex(window.shape), key=lambda s: (-round(window[s], 9), abs(ys[s[0]]) + abs(xs[s[1]]), s))
    return float(ys[y]), float(xs[x]), float(window[y, x] / norm) if norm else 0.0


def shifts_of(frames: DataFrame, templates: DataFrame | dict[str, np.ndarray], most: tuple[int, int] = (40, 40), upsample: int = 1) -> DataFrame:
    """(rec_id, t_idx, dy, dx, r) against templates (rec_id, template), or an image by recording: frames are independent, so
    this is one pass, without a shuffle while the templates are broadcast. Shifts are whole pixels, or doubles in steps of
    1 / ``upsample``."""

    kind = "int" if upsample == 1 else "double"

    def run(batches):
        for batch in batches:
            out = []
            for h, w, pix, template in zip(batch["h"], batch["w"], batch["pix"], batch["template"], strict=True):
                reach = (min(most[0], h // 2 - 1), min(most[1], w // 2 - 1))
                out.append(refined_shift(np.asarray(pix, float).reshape(h, w), np.asarray(template, float).reshape(h, w), reach, upsample))
            yield batch[["rec_id", "t_idx"]].assign(dy=[o[0] for o in out], dx=[o[1] for o in out], r=[o[2] for o in out])

    return _beside(frames, templates).mapInPandas(run, f"rec_id string, t_idx long, dy {kind}, dx {kind}, r double")


def cubic_taps(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), four each, of cubic convolution (Keys, 1981) at fractional places of a row held at its ends."""
    base = np.floor(at)
    t = (at - base)[..., None] + np.array([1, 0, -1, -2])
    d = np.abs(t)
    near, far = ((SHARPNESS + 2) * d - (SHARPNESS + 3)) * d * d + 1, SHARPNESS * (((d - 5) * d + 8) * d - 4)
    return np.clip(base[..., None].astype(int) + np.array([-1, 0, 1, 2]), 0, size - 1), np.where(d <= 1, near, far)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image at fractional places, by cubic convolution."""
    (rows, down), (columns, across) = cubic_taps(y, image.shape[0]), cubic_taps(x, image.shape[1])
    out = np.zeros(np.broadcast_shapes(y.shape, x.shape))
    for i in range(4):
        out += down[..., i] * sum(across[..., j] * image[rows[..., i], columns[..., j]] for j in range(4))
    return out


def moved(image: np.ndarray, dy: float, dx: float, border: str = "copy") -> np.ndarray:
    """The image shifted, by cubic convolution where the shift is no whole number of pixels; what comes in from outside is held
    at the border's value, or NaN."""
    h, w = image.shape
    if dy != int(dy) or dx != int(dx):
        (rows, down), (columns, across) = cubic_taps(np.arange(h) - dy, h), cubic_taps(np.arange(w) - dx, w)
        image = np.einsum("ykx,yk->yx", image[rows].astype(float), down)
        out = np.einsum("yxk,xk->yx", image[:, columns], across)
        if border == "nan":
            out[(np.arange(h) < dy) | (np.arange(h) > h - 1 + dy)] = np.nan
            out[:, (np.arange(w) < dx) | (np.arange(w) > w - 1 + dx)] = np.nan
        return out
    dy, dx = int(dy), int(dx)
    y, x = np.arange(h) - dy, np.arange(w) - dx
    out = image[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)].astype(float)
    if border == "nan":
        out[(y < 0) | (y >= h)] = np.nan
        out[:, (x < 0) | (x >= w)] = np.nan
    return out


def apply_shifts(frames: DataFrame, shifts: DataFrame, border: str = "copy") -> DataFrame:
    rows = frames.join(shifts.select("rec_id", "t_idx", "dy", "dx"), ["rec_id", "t_idx"])

    def run(batches):
        for batch in batches:
            pix = [moved(np.asarray(p, float).reshape(h, w), dy, dx, border).ravel() for h, w, p, dy, dx in zip(batch["h"], batch["w"], batch["pix"], batch["dy"], batch["dx"], strict=True)]
            yield batch.drop(columns=["dy", "dx"]).assign(pix=pix)

    return rows.select(*frames.columns, "dy", "dx").mapInPandas(run, frames.schema)


def piecewise(frames: DataFrame, templates: DataFrame | dict[str, np.ndarray], most: tuple[int, int] = (6, 6), strides: tuple[int, int] = (24, 24), overlaps: tuple[int, int] = (48, 48), deviation: int = 3, upsample: int = 1) -> DataFrame:
    """Frames moved patch by patch: the whole frame's shift, then each patch's own within ``deviation`` of it, interpolated
    between patch centres to a shift a pixel. With ``upsample`` patches' shifts are found to 1 / ``upsample`` of a pixel, and
    pixels are taken between their places by cubic convolution."""

    def field(values: np.ndarray, ys: list[int], xs: list[int], h: int, w: int) -> np.ndarray:
        rows = np.stack([np.interp(np.arange(w), xs, r) for r in values])
        return np.stack([np.interp(np.arange(h), ys, c) for c in rows.T], axis=1)

    def warp(image: np.ndarray, template: np.ndarray) -> np.ndarray:
        h, w = image.shape
        whole = best_shift(image, template, (min(most[0], h // 2 - 1), min(most[1], w // 2 - 1)))[:2]
        size = (min(h, strides[0] + overlaps[0]), min(w, strides[1] + overlaps[1]))
        ys, xs = (sorted({min(i, n - s) for i in range(0, n, t)}) for n, s, t in ((h, size[0], strides[0]), (w, size[1], strides[1])))
        found = np.array([[refined_shift(image[y : y + size[0], x : x + size[1]], template[y : y + size[0], x : x + size[1]], (deviation, deviation), upsample, whole)[:2] for x in xs] for y in ys], float)
        cy, cx = [y + size[0] // 2 for y in ys], [x + size[1] // 2 for x in xs]
        dy, dx = field(found[..., 0], cy, cx, h, w), field(found[..., 1], cy, cx, h, w)
        y, x = np.mgrid[:h, :w]
        if upsample > 1:
            return sampled(image, y - dy, x - dx)
        return image[np.clip(np.rint(y - dy).astype(int), 0, h - 1), np.clip(np.rint(x - dx).astype(int), 0, w - 1)]

    def run(batches):
        for batch in batches:
            pix = [warp(np.asarray(p, float).reshape(h, w), np.asarray(t, float).reshape(h, w)).ravel() for h, w, p, t in zip(batch["h"], batch["w"], batch["pix"], batch["template"], strict=True)]
            yield batch.drop(columns="template").assign(pix=pix)

    return _beside(frames, templates).mapInPandas(run, frames.schema)


def register_rigid(frames: DataFrame, most: tuple[int, int] = (40, 40), iterations: int = 1, border: str = "copy", upsample: int = 1, **interval) -> tuple[DataFrame, DataFrame]:
    """(frames, shifts): against the mean image, which later iterations take from the registered frames."""
    shifts = shifts_of(frames, template_of(frames, **interval), most, upsample)
    out = apply_shifts(frames, shifts, border)
    for _ in range(iterations - 1):
        shifts = shifts_of(frames, template_of(out, **interval), most, upsample)
        out = apply_shifts(frames, shifts, border)
    return out, shifts


def register_on_filtered(frames: DataFrame, most: tuple[int, int] = (6, 6), q_cut: tuple[float, float] = (1, 99), median: int = 3, time: bool = True, upsample: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frames, shifts): shifts are found on a clipped and median-filtered copy and applied to the original."""
    copy = median_filter(frames_of(project.quantile_clip(pixels_of(frames), *q_cut)), median, time)
    shifts = shifts_of(copy, template_of(copy), most, upsample)
    return apply_shifts(frames, shifts), shifts

