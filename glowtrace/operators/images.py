"""Images and frames: neighbourhood filters, peaks, regions, components and flooding."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glowtrace.operators.project import PIXEL
from glowtrace.sources.scratch import checkpointed

#: Frames of a recording that one task puts beside their neighbours in time.
FRAME_CHUNK = 1024


def neighbours(image: DataFrame, h: int, w: int, height: int, width: int, border: str) -> DataFrame:
    """(…, y, x, dy, dx, v): for each pixel the values in its (2h+1) by (2w+1) box; ``border`` is nearest, reflect or none.

    A pixel is sent to the boxes that it falls in, its mirror images beyond the border included."""
    keys = [c for c in image.columns if c not in ("y", "x", "v")]

    def places(c: Column, r: int, n: int) -> Column:
        here = F.array(F.struct(c.alias("p")))
        if border == "reflect":
            return F.filter(F.array(*[F.struct(p.alias("p")) for p in (c, -c - 1, 2 * n - 1 - c)]), lambda s: (s["p"] >= -r) & (s["p"] < n + r))
        if border == "nearest":
            low = F.transform(F.sequence(F.lit(-r), F.lit(0)), lambda i: F.struct(i.alias("p")))
            high = F.transform(F.sequence(F.lit(n - 1), F.lit(n - 1 + r)), lambda i: F.struct(i.alias("p")))
            return F.when(c == 0, low).when(c == n - 1, high).otherwise(here)
        return here

    rows = image.select(*keys, F.explode(places(F.col("y"), h, height)).alias("py"), "x", "v").select(*keys, "py", F.explode(places(F.col("x"), w, width)).alias("px"), "v")
    offsets = F.flatten(F.transform(F.sequence(F.lit(-h), F.lit(h)), lambda dy: F.transform(F.sequence(F.lit(-w), F.lit(w)), lambda dx: F.struct(dy.alias("dy"), dx.alias("dx")))))
    rows = rows.select(*keys, "py", "px", "v", F.explode(offsets).alias("o"))
    rows = rows.select(*keys, (F.col("py.p") - F.col("o.dy")).cast("int").alias("y"), (F.col("px.p") - F.col("o.dx")).cast("int").alias("x"), "o.dy", "o.dx", "v")
    return rows.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def box_filter(image: DataFrame, h: int, w: int, height: int, width: int, border: str, agg: Column) -> DataFrame:
    keys = [c for c in image.columns if c not in ("y", "x", "v")]
    return neighbours(image, h, w, height, width, border).groupBy(*keys, "y", "x").agg(agg.alias("v"))


def median_filter(frames: DataFrame, size: int = 3, time: bool = False) -> DataFrame:
    """Frames (rec_id, t_idx, h, w, pix) through a median of ``size`` by ``size``, with ``time`` of as many frames; ends
    reflected. Frames stay arrays; in time each frame is joined by its neighbours through a window, never by a self-join. A
    recording is cut into chunks of time for that; frames near a border are in both chunks."""
    r = size // 2
    if time:
        n, i = frames.groupBy("rec_id").agg(F.count("*").alias("_n")), F.col("t_idx")
        near = F.sequence(F.expr(f"greatest(t_idx - {r}, 0) div {FRAME_CHUNK}"), F.expr(f"(t_idx + {r}) div {FRAME_CHUNK}"))
        order = Window.partitionBy("rec_id", "_chunk").orderBy("t_idx")
        stack = F.collect_list(F.struct("t_idx", "pix")).over(order.rowsBetween(-r, r))
        schema = frames.columns
        frames = frames.withColumn("_chunk", F.explode(near)).withColumn("_s", stack).where(F.expr(f"t_idx div {FRAME_CHUNK}") == F.col("_chunk"))
        frames = frames.join(n, "rec_id").select(*schema, "_s", "_n")

        def at(o: int) -> Column:
            t = i + o
            mirrored = F.when(t < 0, -t - 1).when(t >= F.col("_n"), 2 * F.col("_n") - 1 - t).otherwise(t)
            return F.filter("_s", lambda s: s["t_idx"] == mirrored)[0]["pix"]

        frames = frames.withColumn("pix", F.flatten(F.array(*[at(o) for o in range(-r, size - r)]))).drop("_s", "_n")

    def run(batches):
        for batch in batches:
            out = []
            for h, w, pix in zip(batch["h"], batch["w"], batch["pix"], strict=True):
                cube = np.pad(np.asarray(pix, float).reshape(-1, h, w), ((0, 0), (r, r), (r, r)), mode="symmetric")
                box = np.lib.stride_tricks.sliding_window_view(cube, (size, size), axis=(1, 2))
                out.append(np.median(box.transpose(1, 2, 0, 3, 4).reshape(h * w, -1), axis=1))
            yield batch.assign(pix=out)

    return frames.mapInPandas(run, frames.schema)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames through a NumPy kernel of one image, in Arrow batches; frames are independent, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            images = [kernel(np.asarray(p, float).reshape(h, w)) for h, w, p in zip(batch["h"], batch["w"], batch["pix"], strict=True)]
            yield batch.assign(h=[i.shape[0] for i in images], w=[i.shape[1] for i in images], pix=[i.ravel() for i in images])

    return frames.mapInPandas(run, frames.schema)


def gaussian_blur(image: DataFrame, height: int, width: int, size: int = 5, sigma: float = 1.0) -> DataFrame:
    r = size // 2
    one = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    one = (one / one.sum()).tolist()
    weights = F.array(*[F.lit(w) for w in one])
    rows = neighbours(image, r, r, height, width, "nearest")
    keys = [c for c in image.columns if c not in ("y", "x", "v")]
    part = F.col("v") * F.get(weights, F.col("dy") + r) * F.get(weights, F.col("dx") + r)
    return rows.groupBy(*keys, "y", "x").agg(F.sum(part).alias("v"))


def detect_peaks(image: DataFrame, height: int, width: int, relative: int = 3, edge: int = 5) -> DataFrame:
    """Pixels that equal the maximum of the (height // relative) by (width // relative) box around them, without those
    nearer than ``edge`` to the border; 0 clears none. A pixel's own value comes from its box too: an image that is
    computed twice, as for a join with its maxima, adds up in another order and differs in its last digits."""
    keys = [c for c in image.columns if c not in ("y", "x", "v")]
    bh, bw = height // relative, width // relative
    rows = neighbours(image, bh // 2, bw // 2, height, width, "reflect")
    rows = rows.where(F.col("dy").between(-(bh // 2), bh - 1 - bh // 2) & F.col("dx").between(-(bw // 2), bw - 1 - bw // 2))
    own = F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("v"))
    found = rows.groupBy(*keys, "y", "x").agg(F.max(own).alias("v"), F.max("v").alias("top"))
    return found.where((F.col("v") == F.col("top")) & F.col("y").between(edge, height - 1 - edge) & F.col("x").between(edge, width - 1 - edge)).drop("top")


def peaks_with_retry(image: DataFrame, height: int, width: int, relative: int = 3, edge: int = 5) -> DataFrame:
    """The peaks at the largest edge, up to ``edge``, that leaves more than one; all if none does. These are the peaks of the
    two first ranks by their distance from the border, distances cut to ``edge``; peaks are found once, not once more for
    the edge."""
    peaks = detect_peaks(image, height, width, relative, 0)
    away = F.least("y", "x", height - 1 - F.col("y"), width - 1 - F.col("x"), F.lit(edge))
    farthest = Window.partitionBy("rec_id").orderBy(F.desc("_away"))
    return peaks.withColumn("_away", away).withColumn("_rank", F.rank().over(farthest)).where("_rank <= 2").drop("_away", "_rank")


def roi_stats(mask: DataFrame) -> DataFrame:
    """(rec_id, roi_id, com_y, com_x, pixels)."""
    return mask.groupBy("rec_id", "roi_id").agg(F.avg("y").alias("com_y"), F.avg("x").alias("com_x"), F.count("*").alias("pixels"))


def roi_size_filter(mask: DataFrame, height: int, width: int, min_size: int, edge: int, strip: bool = False) -> DataFrame:
    """Regions with more than ``min_size`` pixels inside the edge; with ``strip`` without their edge pixels."""
    inside = F.col("y").between(edge, height - 1 - edge) & F.col("x").between(edge, width - 1 - edge)
    big = mask.groupBy("rec_id", "roi_id").agg(F.count_if(inside).alias("n")).where(F.col("n") > min_size).select("rec_id", "roi_id")
    return (mask.where(inside) if strip else mask).join(big, ["rec_id", "roi_id"], "left_semi")


def scaled_weights(mask: DataFrame, image: DataFrame, sign: int = -1) -> DataFrame:
    """Masks weighted by the image, scaled to 0 to 1 in each region."""
    rows = mask.drop("weight").join(image, list(PIXEL)).withColumn("p", -sign * F.col("v"))
    w = Window.partitionBy("rec_id", "roi_id")
    lo, hi = F.min("p").over(w), F.max("p").over(w)
    return rows.select("rec_id", "roi_id", "y", "x", F.coalesce(F.try_divide(F.col("p") - lo, hi - lo), F.lit(1.0)).alias("weight"))


def binary_threshold(image: DataFrame, threshold: float) -> DataFrame:
    return image.withColumn("v", F.when(F.col("v") > threshold, 1).otherwise(0))


#: Side of the tiles that images are labelled in.
TILE = 512


def tile_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel the place of its 8-connected component's first one in raster order: runs of rows, joined with those of
    the row above that they touch."""
    order = np.lexsort((x, y))
    ys, xs = y[order].astype(np.int64), x[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(ys) != 0) | (np.diff(xs) != 1)])) if len(ys) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(ys)]]) - 1
    row, low, high = ys[starts], xs[starts], xs[ends] if len(ys) else xs
    parent = list(range(len(starts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # The first run above that reaches a run, and the last; both from sorted rows and columns.
    wide = int(xs.max(initial=0)) + 3
    first = np.searchsorted(row * wide + high, (row - 1) * wide + low - 1)
    last = np.searchsorted(row * wide + low, (row - 1) * wide + high + 1, "right")
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for j in range(a, b):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
    roots = np.array([root(i) for i in range(len(starts))], np.int64)
    out = np.empty(len(ys), np.int64)
    out[order] = np.repeat(order[starts[roots]] if len(roots) else roots, ends - starts + 1)
    return out


def least_of_links(links: DataFrame) -> DataFrame:
    """(rec_id, id, least): the smallest id that links (rec_id, u, v) lead to, for all that isn't it. Alternating large and small
    stars (Kiveris et al., 2014); a step is a checkpoint, and their number grows with the logarithm of the longest chain."""
    spark = links.sparkSession
    now = links.where("u <> v").select("rec_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = checkpointed(spark, now), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("rec_id", "u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select("rec_id", F.col("u").alias("id"), F.col("v").alias("least"))
        turned = now.select("rec_id", F.col("v").alias("u"), F.col("u").alias("v"))
        near = now.union(turned).groupBy("rec_id", "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = turned.join(near, ["rec_id", "u"]).select("rec_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("rec_id", "u").agg(F.min("v").alias("m"))
        small = large.join(root, ["rec_id", "u"]).where("v > m").select("rec_id", F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = mark, checkpointed(spark, small.union(root.select("rec_id", "u", F.col("m").alias("v"))).distinct())


def connected_components(image: DataFrame, label: str = "label") -> DataFrame:
    """(rec_id, y, x, label) of the non-zero pixels, 8-connected: labels from 1 in raster order of each component's first
    pixel. A tile is labelled in one task; only pixels at the borders of tiles are joined with their neighbours, and what meets
    afterwards is a row a pair of touching components of two tiles. So images of any size, and components over all of one,
    are cut over tasks. An image within one tile has no borders."""
    spark = image.sparkSession
    kinds = dict(image.dtypes)
    side = TILE
    tile = [F.floor(F.col(c) / side).cast("long").alias(f"t{c}") for c in "yx"]
    fore = image.where("v <> 0").select("rec_id", "y", "x", *tile)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group["y"].to_numpy(np.int64), group["x"].to_numpy(np.int64)
        at = tile_components(y - y.min(), x - x.min())
        return group[["rec_id", "y", "x"]].assign(root=(y[at] << 31) + x[at])

    tiled = checkpointed(spark, fore.groupBy("rec_id", "ty", "tx").applyInPandas(run, f"rec_id {kinds['rec_id']}, y {kinds['y']}, x {kinds['x']}, root long"))
    edge = tiled.where(F.expr(" or ".join(f"{c} % {side} in (0, {side - 1})" for c in "yx")))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])  # each pair once
    sent = edge.select("rec_id", "y", "x", F.col("root").alias("u"), F.explode(steps).alias("o"))
    sent = sent.select("rec_id", "u", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"), "y", "x").where(f"ny div {side} <> y div {side} or nx div {side} <> x div {side}")
    links = sent.drop("y", "x").join(edge.select("rec_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("root").alias("v")), ["rec_id", "ny", "nx"]).select("rec_id", "u", "v")
    joined = least_of_links(links).withColumnRenamed("id", "root")
    whole = tiled.join(joined, ["rec_id", "root"], "left").select("rec_id", "y", "x", F.coalesce("least", "root").alias("root"))
    roots = whole.where(F.col("root") == F.col("y").cast("long") * (1 << 31) + F.col("x"))
    roots = roots.withColumn(label, F.row_number().over(Window.partitionBy("rec_id").orderBy("root"))).select("rec_id", "root", label)
    return whole.join(roots, ["rec_id", "root"]).select("rec_id", "y", "x", label)


def flood(v: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Priority flood of 0-marked pixels from the markers, lowest first; -1 where two regions meet."""
    h, w = v.shape
    out, queue, n = markers.copy(), [], 0
    steps = ((-1, 0), (0, -1), (0, 1), (1, 0))
    seen = markers != 0

    def push(y: int, x: int) -> None:
        nonlocal n
        for dy, dx in steps:
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and not seen[a, b]:
                seen[a, b] = True
                heapq.heappush(queue, (float(v[a, b]), n, a, b))
                n += 1

    for y, x in zip(*np.nonzero(markers), strict=True):
        push(int(y), int(x))
    while queue:
        _, _, y, x = heapq.heappop(queue)
        labels = {int(out[y + dy, x + dx]) for dy, dx in steps if 0 <= y + dy < h and 0 <= x + dx < w} - {0, -1}
        out[y, x] = labels.pop() if len(labels) == 1 else -1
        if out[y, x] != -1:
            push(y, x)
    return out


def watershed_rois(image: DataFrame, height: int, width: int, thresh: float = 2, upper: float = 2.5, lower: float = 1.5, min_size: int = 9, edge: int = 0, strip: bool = False, background: bool = False) -> DataFrame:
    """(rec_id, roi_id, y, x, weight): components above ``upper`` grow into pixels above ``lower``, highest first, up to the
    background below; regions are filtered by size. ``background`` adds the background as region 0. An image is one group:
    it is as large as a frame, whatever the recording's length."""
    fore = connected_components(binary_threshold(image, upper)).withColumnRenamed("label", "marker")
    rows = image.join(fore, list(PIXEL), "left").select(*PIXEL, "v", F.when(F.col("marker").isNotNull(), F.col("marker") + 1).when(F.col("v") > lower, 0).otherwise(1).cast("int").alias("marker"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        v, m = np.zeros((height, width)), np.ones((height, width), int)
        v[frame["y"], frame["x"]], m[frame["y"], frame["x"]] = frame["v"], frame["marker"]
        return frame[["rec_id", "y", "x"]].assign(roi_id=flood(-v, m)[frame["y"], frame["x"]].astype(np.int32))

    kinds = dict(image.dtypes)
    grown = rows.groupBy("rec_id").applyInPandas(grow, f"rec_id string, y {kinds['y']}, x {kinds['x']}, roi_id int")
    mask = grown.where("roi_id > 1").select("rec_id", (F.col("roi_id") - 1).alias("roi_id"), "y", "x", F.lit(1.0).alias("weight"))
    mask = roi_size_filter(mask, height, width, min_size, edge, strip)
    if background:
        mask = mask.unionByName(grown.where("roi_id = 1").select("rec_id", F.lit(0).alias("roi_id"), "y", "x", F.lit(1.0).alias("weight")))
    return mask


def rasterise(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """(rec_id, roi_id, y, x, weight) of polygons (rec_id, roi_id, vertices array<struct<x, y>>) by the even-odd rule at pixel
    centres. Pixels are made from each polygon's own bounding box."""
    lo, hi = (lambda c: F.array_min(F.col(f"vertices.{c}"))), (lambda c: F.array_max(F.col(f"vertices.{c}")))
    ys = F.sequence(F.greatest(F.floor(lo("y")), F.lit(0)).cast("int"), F.least(F.ceil(hi("y")), F.lit(height - 1)).cast("int"))
    xs = F.sequence(F.greatest(F.floor(lo("x")), F.lit(0)).cast("int"), F.least(F.ceil(hi("x")), F.lit(width - 1)).cast("int"))
    rows = polygons.select("rec_id", "roi_id", "vertices", F.explode(ys).alias("y"), xs.alias("xs")).select("rec_id", "roi_id", "vertices", "y", F.explode("xs").alias("x"))
    edges = F.transform(F.col("vertices"), lambda p, i: F.struct(p.alias("a"), F.get("vertices", (i + 1) % F.size("vertices")).alias("b")))
    crosses = lambda e: ((e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))) & (F.col("x") < e["a"]["x"] + F.try_divide((e["b"]["x"] - e["a"]["x"]) * (F.col("y") - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]))
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return rows.where(inside).select("rec_id", "roi_id", "y", "x", F.lit(1.0).alias("weight"))


def resize(frames: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear, pixel centres aligned, borders held."""

    def kernel(image: np.ndarray) -> np.ndarray:
        def axis(n: int, m: int):
            p = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
            i = np.minimum(p.astype(int), max(n - 2, 0))
            return i, np.minimum(i + 1, n - 1), p - i

        (y0, y1, fy), (x0, x1, fx) = axis(image.shape[0], height), axis(image.shape[1], width)
        rows = image[y0] * (1 - fy)[:, None] + image[y1] * fy[:, None]
        return rows[:, x0] * (1 - fx) + rows[:, x1] * fx

    return map_frames(frames, kernel)


def resize_by(frames: DataFrame, height: int, width: int, mode: str | None, size: int = 256) -> DataFrame:
    """Frames as they are (None), larger by the largest whole factor that ``size`` has room for (``expand``), or as squares of
    that size (``full``). ``resize`` to the first height and width undoes it."""
    if mode is None:
        return frames
    if mode == "full":
        return resize(frames, size, size)
    if mode != "expand":
        raise ValueError(f"mode must be None, expand or full, not {mode!r}")
    factor = size // max(height, width)
    if not factor:
        raise ValueError("the image is larger than the size")
    return frames if factor == 1 else resize(frames, height * factor, width * factor)
