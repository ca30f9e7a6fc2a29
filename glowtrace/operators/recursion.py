"""Recursive filters over series cut into chunks of time, which meet only in a scan of their states.

A recursion maps the state before a chunk to the state after it by an affine map, state -> step^n state + what the chunk's own
samples leave. So chunks are run once from rest, in any number of tasks; a series' chain of small maps gives each chunk the
state that it starts from; and chunks are run again from there. For a filter forwards and backwards the chain goes back as
well: what a chunk's first pass leaves for the second is linear in its samples and in its starting state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glowtrace.operators.windows import KEYS
from glowtrace.sources.scratch import checkpointed

#: Rows of time in a chunk, the samples that a filter takes at once in it, and the chunks up to which states are broadcast.
CHUNK, BLOCK, BROADCAST_CHUNKS = 1 << 16, 128, 50_000
#: What is left of a state when none of its digits counts any more.
FORGOTTEN = 1e-30


class Recursion:
    """The difference equation b, a as a state space: y = b0 x + z0, z -> step z + gain x."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        n = max(len(a), len(b))
        self.b, self.a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
        self.order = n - 1
        self.step = np.eye(self.order, k=1)
        self.step[:, :1] = -self.a[1:, None]
        self.gain = self.b[1:] - self.a[1:] * self.b[0]
        powers = [np.eye(self.order)]
        for _ in range(BLOCK):
            powers.append(self.step @ powers[-1])
        self._seen = np.array([p[0] for p in powers[:BLOCK]]) if self.order else np.zeros((BLOCK, 0))
        impulse = np.concatenate([self.b[:1], self._seen[:-1] @ self.gain])
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        self._through = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self._carry, self._enter = powers[BLOCK], np.array([p @ self.gain for p in powers[BLOCK - 1 :: -1]])

    @property
    def rest(self) -> np.ndarray:
        return np.zeros(self.order)

    @property
    def steady(self) -> np.ndarray:
        """The state after a long step of height 1."""
        return np.linalg.solve(np.eye(self.order) - self.step, self.gain)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, state after them): only states go from block to block, the rest is matrix products."""
        x = np.asarray(x, float)
        odd = np.flatnonzero(~np.isfinite(x))
        if len(odd):  # a block's products would carry it back in time
            y, state = self.run(x[: odd[0]], state)
            out = []
            for v in x[odd[0] :]:
                out.append(self.b[0] * v + (state[0] if self.order else 0.0))
                state = self.step @ state + self.gain * v
            return np.concatenate([y, out]), state
        whole = len(x) // BLOCK * BLOCK
        blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
        states = np.empty((len(blocks), self.order))
        for i, entered in enumerate(blocks @ self._enter):
            states[i] = state
            if i < whole // BLOCK:
                state = self._carry @ state + entered
        for v in x[whole:]:
            state = self.step @ state + self.gain * v
        return (states @ self._seen.T + blocks @ self._through.T).ravel()[: len(x)], state


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Roots of a real polynomial as real pairs: conjugates, and real ones two by two, the last perhaps alone."""
    upper, real = roots[roots.imag > 1e-12], np.sort(roots[np.abs(roots.imag) <= 1e-12].real)[::-1]
    return [np.array([r, np.conj(r)]) for r in upper] + [real[i : i + 2] for i in range(0, len(real), 2)]


class Cascade:
    """A filter b, a as sections of second order, one after the other: high orders lose digits in one piece. Its state is that
    of all sections."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        n = max(len(a), len(b))
        b, a = np.pad(np.asarray(b, float), (0, n - len(b))), np.pad(np.asarray(a, float), (0, n - len(a)))
        poles = sorted(_pairs(np.roots(a)), key=lambda p: (-len(p), np.abs(p).max()))
        zeros = _pairs(np.roots(b))
        self.sections = []
        for p in reversed(poles):  # those nearest to the circle choose first
            fits = [z for z in zeros if len(z) <= len(p)]
            z = min(fits, key=lambda z: np.abs(z[0] - p[0]), default=np.empty(0))
            zeros = [v for v in zeros if v is not z]
            self.sections.insert(0, [np.pad(np.atleast_1d(np.real(np.poly(z))), (len(p) - len(z), 0)), np.real(np.poly(p))])
        gain = b[np.flatnonzero(b)[0]] / a[0] if b.any() else 0.0
        if zeros or not self.sections:  # no poles for some zeros, as with an odd number of either: one piece
            self.sections = [[b / a[0], a / a[0]]]
        else:
            self.sections[0][0] = self.sections[0][0] * gain
        self.sections = [Recursion(*s) for s in self.sections]
        self.cuts = np.cumsum([s.order for s in self.sections])[:-1]
        self.order = sum(s.order for s in self.sections)
        #: Samples by which a series is extended at both ends before it is filtered forwards and backwards.
        self.overhang = 3 * n
        # Samples after which no digit of a state is left; None if that takes very many.
        self.horizon = None
        slowest = max((np.abs(p).max() for p in poles), default=0.0)
        if slowest < 1 - 1e-9:
            self.horizon = BLOCK * (2 + int(np.log(FORGOTTEN) / np.log(max(slowest, 1e-3)) / BLOCK))

    @property
    def rest(self) -> np.ndarray:
        return np.zeros(self.order)

    @property
    def steady(self) -> np.ndarray:
        """The state after a long step of height 1."""
        out, height = [], 1.0
        for s in self.sections:
            out.append(s.steady * height)
            height *= s.b.sum() / s.a.sum()
        return np.concatenate(out) if out else self.rest

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = []
        for s, z in zip(self.sections, np.split(state, self.cuts), strict=True):
            x, z = s.run(x, z)
            after.append(z)
        return x, np.concatenate(after)

    def echo(self, state: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(the state after n samples of zero, what its outputs until then, run backwards from rest, leave), for which the
        filter is run up to where the state is forgotten."""
        m = n if self.horizon is None else min(n, self.horizon)
        y, after = self.run(np.zeros(m), state)
        return after if m == n else self.rest, self.run(y[::-1], self.rest)[1]


def filtered(x: np.ndarray, filt: Cascade, both_ways: bool) -> np.ndarray:
    """A whole series at once: from rest, or forwards and backwards over its extension by its odd reflection."""
    if not both_ways:
        return filt.run(x, filt.rest)[0]
    pad = min(filt.overhang, len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = filt.run(ext, filt.steady * ext[0])[0][::-1]
    return filt.run(y, filt.steady * y[0])[0][::-1][pad : pad + len(x)]


def entries(chunks: Sequence[dict], filt: Cascade, both_ways: bool) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(state before, state before on the way back) of a series' chunks in order, from their n, ahead, back, head and tail;
    None for a series of one sample, which filtering both ways leaves as it is."""
    if not both_ways:
        state, out = filt.rest, []
        for c in chunks:
            out.append((state, filt.rest))
            state = filt.echo(state, c["n"])[0] + c["ahead"]
        return out
    pad = min(filt.overhang, sum(c["n"] for c in chunks) - 1)
    if pad < 1:
        return None
    head, tail = np.empty(0), np.empty(0)
    for c in chunks:
        head = np.concatenate([head, c["head"]])
        if len(head) > pad:
            break
    for c in reversed(chunks):
        tail = np.concatenate([c["tail"], tail])
        if len(tail) > pad:
            break
    before = 2 * head[0] - head[pad:0:-1]
    state, ahead, back = filt.run(before, filt.steady * before[0])[1], [], []
    for c in chunks:
        ahead.append(state)
        state, left = filt.echo(state, c["n"])
        state = state + c["ahead"]
        back.append(left + c["back"])
    y = filt.run(2 * tail[-1] - tail[-2 : -pad - 2 : -1], state)[0][::-1]
    state, out = filt.run(y, filt.steady * y[0])[1], []
    for c, started, left in zip(reversed(chunks), reversed(ahead), reversed(back), strict=True):
        out.append((started, state))
        state = filt.echo(state, c["n"])[0] + left
    return out[::-1]


def recursive_filter(rows: DataFrame, b: Sequence[float], a: Sequence[float], both_ways: bool, keys: Sequence[str] = KEYS, value: str = "f", chunk: int | None = None) -> DataFrame:
    """(keys, t_idx, value): series (keys, t_idx, value) in the order of t_idx, filtered from rest or forwards and backwards.

    A chunk is ``chunk`` consecutive values of t_idx, gaps left out. Rows are shuffled into chunks and written once; the scan of
    a series holds a few dozen numbers a chunk. A NULL is NaN, and so are all samples after it, and before it on the way
    back. Null keys are keys like others."""
    spark, filt = rows.sparkSession, Cascade(b, a)
    kinds = dict(rows.dtypes)
    whole = F.struct(*keys).alias("_of")
    place = F.expr(f"cast(t_idx as long) div {chunk or CHUNK}")
    cells = F.array_sort(F.collect_list(F.struct(F.col("t_idx").cast("long").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))))
    packed = rows.select(whole, place.alias("_chunk"), "t_idx", value).groupBy("_of", "_chunk").agg(cells.alias("c"))
    packed = checkpointed(spark, packed.select("_of", "_chunk", F.col("c.t").alias("t"), F.col("c.v").alias("v")))
    of = f"_of {packed.schema['_of'].dataType.simpleString()}, _chunk long"
    keep = filt.overhang + 1

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["v"]:
                y, ahead = filt.run(x, filt.rest)
                out.append((len(x), ahead, filt.run(y[::-1], filt.rest)[1] if both_ways else filt.rest, x[:keep], x[-keep:]))
            yield batch[["_of", "_chunk"]].assign(**dict(zip(("n", "ahead", "back", "head", "tail"), map(list, zip(*out, strict=True)), strict=True)))

    summary = packed.select("_of", "_chunk", "v").mapInPandas(summarise, f"{of}, n long, ahead array<double>, back array<double>, head array<double>, tail array<double>")

    def scan(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("_chunk")
        found = entries(series.to_dict("records"), filt, both_ways)
        none = np.empty(0)
        return series[["_of", "_chunk"]].assign(enter=[f[0] for f in found] if found else [none] * len(series), leave=[f[1] for f in found] if found else [none] * len(series))

    states = checkpointed(spark, summary.groupBy("_of").applyInPandas(scan, f"{of}, enter array<double>, leave array<double>"))
    states = F.broadcast(states) if states.count() <= BROADCAST_CHUNKS else states

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, enter, leave in zip(batch["v"], batch["enter"], batch["leave"], strict=True):
                if len(enter) < filt.order:
                    out.append(x)
                    continue
                y = filt.run(x, enter)[0]
                out.append(filt.run(y[::-1], leave)[0][::-1] if both_ways else y)
            yield batch[["_of", "t"]].assign(v=out)

    done = packed.join(states, ["_of", "_chunk"]).mapInPandas(finish, f"{of.split(', _chunk')[0]}, t array<long>, v array<double>")
    cells = done.select("_of", F.explode(F.arrays_zip("t", "v")).alias("c"))
    return cells.select(*[F.col(f"_of.{k}").alias(k) for k in keys], F.col("c.t").cast(kinds["t_idx"]).alias("t_idx"), F.col("c.v").alias(value))
