"""Binomial dynamic generalised linear models, filtered series by series.

The Beta-binomial filter of West, Harrison and Migon (1985): with regression vector F and state
(a, R), f = F'a and q = F'RF are matched to a Beta(alpha, beta) prior of the probability by
psi(alpha) - psi(beta) = f and psi'(alpha) + psi'(beta) = q; the forecast is alpha / (alpha + beta);
after y of n, f* and q* of the updated Beta give m = a + RF (f* - f) / q and
C = R - RFF'R (1 - q* / q) / q; then a = Gm and R = GCG' with discounts by block. A slot with
n = 0 evolves without an observation.

Series are independent, so they are dealt over the cluster by key. A task takes them as they come,
sorted, and filters TOGETHER of them side by side: each step is a few numpy calls for all. A series'
length is bounded by the time axis. The state after a series' last row, with its full covariance,
comes with that row; given to a later run, it goes on as if there had been one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Series that are filtered side by side, rows that a task collects for them at most, beyond one series, and rows that it hands over at once.
TOGETHER, ROWS, HANDED = 1024, 200_000, 20_000
#: Log odds beyond this count as this, in the match and in the update alike; alpha and beta stay within a double.
WIDEST = 500.0


def polygammas(x: float) -> tuple[float, float, float]:
    """digamma, trigamma and tetragamma of x > 0: recurrence up to 6, then the asymptotic series."""
    d = t = u = 0.0
    while x < 6:
        r = 1 / x
        d -= r
        t += r * r
        u -= 2 * r * r * r
        x += 1
    r = 1 / x
    s = r * r
    d += math.log(x) - 0.5 * r - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    t += r + s / 2 + s * r * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66))))
    u += -s - s * r - s * s * (0.5 - s * (1 / 6 - s * (1 / 6 - s * 0.3)))
    return d, t, u


def _starts(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of alpha and beta that Newton steps begin from.

    With little variance psi(x) is near log x. With much, the smaller of the two has psi'(x) near
    1 / x^2 and takes most of q; the other follows from psi, which is near log(x - 1/2) or -1 / x.
    """
    la, lb = np.log((1 + np.exp(f)) / q), np.log((1 + np.exp(-f)) / q)
    wide = q > 4
    if wide.any():
        least = 1 / np.sqrt(np.maximum(q, 4.0) - 1.5)
        psi = np.abs(f) + polygammas_of(least)[0]
        other = np.where(psi > -2.2, np.exp(psi) + 0.5, -1 / np.minimum(psi + 0.5772, -0.1))
        least, other = np.log(least), np.log(np.maximum(other, least))
        other = np.where(f == 0, least, other)  # even odds stay exactly even
        la = np.where(wide, np.where(f < 0, least, other), la)
        lb = np.where(wide, np.where(f < 0, other, least), lb)
    return la, lb


#: Grid of |f| and log q that solutions are tabled on: the step, the largest |f|, the least and largest log q.
_STEP, _FAR, _LOW, _HIGH = 0.05, 60.0, -14.0, 10.0


@functools.cache
def _solved() -> np.ndarray:
    """(|f|, log q): logarithms of alpha, and of beta as the imaginary part, on the grid."""
    f, q = np.meshgrid(np.arange(0, _FAR + 2 * _STEP, _STEP), np.exp(np.arange(_LOW, _HIGH + 2 * _STEP, _STEP)), indexing="ij")
    alpha, beta = _newton(f.ravel(), q.ravel(), *_starts(f.ravel(), q.ravel()))
    return (np.log(alpha) + 1j * np.log(beta)).reshape(f.shape)


def _near(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_starts() that lie within some 1e-3 of the solution: between those of the grid, where it reaches."""
    table, u, v = _solved(), np.abs(f) / _STEP, (np.log(q) - _LOW) / _STEP
    inside = (u < _FAR / _STEP) & (v >= 0) & (v < (_HIGH - _LOW) / _STEP)
    u, v = np.where(inside, u, 0.0), np.where(inside, v, 0.0)
    i, j = u.astype(int), v.astype(int)
    u, v = u - i, v - j
    flat, at = table.ravel(), i * table.shape[1] + j
    low, high = ((1 - v) * flat.take(k) + v * flat.take(k + 1) for k in (at, at + table.shape[1]))
    own = (1 - u) * low + u * high
    less = f < 0
    la, lb = np.where(less, own.imag, own.real), np.where(less, own.real, own.imag)
    if not inside.all():
        la[~inside], lb[~inside] = _starts(f[~inside], q[~inside])
    return la, lb


def beta_of(f: float, q: float) -> tuple[float, float]:
    """alpha, beta with psi(alpha) - psi(beta) = f and psi'(alpha) + psi'(beta) = q, by Newton steps on logarithms."""
    q = max(q, 1e-10)
    f = min(WIDEST, max(-WIDEST, f))
    la, lb = (float(x[0]) for x in _starts(np.array([f]), np.array([q])))
    for _ in range(60):
        a, b = math.exp(la), math.exp(lb)
        da, ta, ua = polygammas(a)
        db, tb, ub = polygammas(b)
        r1, r2 = da - db - f, (ta + tb) / q - 1
        if abs(r1) < 1e-10 and abs(r2) < 1e-10:
            break
        j11, j12 = a * ta, -b * tb
        j21, j22 = a * ua / q, b * ub / q
        det = j11 * j22 - j12 * j21
        if det == 0 or not math.isfinite(det):
            break
        step_a, step_b = (r1 * j22 - r2 * j12) / det, (j11 * r2 - j21 * r1) / det
        most = max(1.0, abs(step_a), abs(step_b))
        la, lb = la - step_a / most, lb - step_b / most
    return math.exp(la), math.exp(lb)


def polygammas_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """polygammas() of each number; all go up by 6, in a few calls for any numbers."""
    x = x.astype(float)
    d, t, u = np.zeros((3, len(x)))
    r, s = np.empty((2, len(x)))
    for _ in range(6):
        np.divide(1.0, x, out=r)
        d -= r
        np.multiply(r, r, out=s)
        t += s
        s *= r
        u += s
        x += 1
    u *= -2
    np.divide(1.0, x, out=r)
    np.multiply(r, r, out=s)
    d += np.log(x) - 0.5 * r - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    t += r + s / 2 + s * r * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66))))
    u += -s - s * r - s * s * (0.5 - s * (1 / 6 - s * (1 / 6 - s * 0.3)))
    return d, t, u


def betas_of(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """beta_of() of each pair."""
    q, f = np.maximum(q, 1e-10), np.clip(f, -WIDEST, WIDEST)
    return _newton(f, q, *_near(f, q))


def _newton(f: np.ndarray, q: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps from la and lb until what is left is under 1e-10, or the step, whose square is what it leaves, under 1e-6."""
    todo = np.arange(len(f))
    for _ in range(60):
        a, b = np.exp(la[todo]), np.exp(lb[todo])
        (da, db), (ta, tb), (ua, ub) = (x.reshape(2, -1) for x in polygammas_of(np.concatenate((a, b))))
        r1, r2 = da - db - f[todo], (ta + tb) / q[todo] - 1
        j11, j12, j21, j22 = a * ta, -b * tb, a * ua / q[todo], b * ub / q[todo]
        with np.errstate(all="ignore"):
            det = j11 * j22 - j12 * j21
            step_a, step_b = (r1 * j22 - r2 * j12) / det, (j11 * r2 - j21 * r1) / det
        go = ((np.abs(r1) >= 1e-10) | (np.abs(r2) >= 1e-10)) & (det != 0) & np.isfinite(det)
        if not go.any():
            break
        todo, step_a, step_b = todo[go], step_a[go], step_b[go]
        most = np.maximum(1.0, np.maximum(np.abs(step_a), np.abs(step_b)))
        la[todo] -= step_a / most
        lb[todo] -= step_b / most
        todo = todo[(np.abs(step_a) >= 1e-6) | (np.abs(step_b) >= 1e-6)]
        if not len(todo):
            break
    return np.exp(la), np.exp(lb)


@dataclass
class Design:
    """A level, harmonics of given periods, and regressors; discounts of 1 keep the state static."""

    regressors: int
    level: bool = True
    periods: list[tuple[int, int]] = field(default_factory=list)  # (period in slots, harmonics)
    discount_level: float = 1.0
    discount_season: float = 1.0
    discount_regression: float = 1.0

    @property
    def size(self) -> int:
        return int(self.level) + 2 * sum(h for _, h in self.periods) + self.regressors

    def evolution(self) -> tuple[np.ndarray, np.ndarray]:
        """G, and by what each entry of the covariance is divided."""
        g, blocks, at = np.eye(self.size), [], int(self.level)
        if self.level:
            blocks.append((0, 1, self.discount_level))
        for period, harmonics in self.periods:
            for h in range(1, harmonics + 1):
                w = 2 * math.pi * h / period
                g[at : at + 2, at : at + 2] = [[math.cos(w), math.sin(w)], [-math.sin(w), math.cos(w)]]
                blocks.append((at, at + 2, self.discount_season))
                at += 2
        if self.regressors:
            blocks.append((at, self.size, self.discount_regression))
        scale = np.ones((self.size, self.size))
        for a, b, d in blocks:
            scale[a:b, a:b] = d
        return g, scale

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """F of each row: 1 for the level, (1, 0) for each harmonic, and the regressors."""
        head = [1.0] * self.level + [1.0, 0.0] * sum(h for _, h in self.periods)
        return np.concatenate((np.tile(head, (len(x), 1)), x), axis=1) if head else x


@dataclass
class State:
    a: np.ndarray
    r: np.ndarray

    @classmethod
    def prior(cls, size: int, variance: float) -> State:
        return cls(np.zeros(size), np.eye(size) * variance)


def prior_of(state: State, f_vec: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
    """RF, f, q, and the alpha and beta that match them."""
    rf = state.r @ f_vec
    f, q = min(WIDEST, max(-WIDEST, float(f_vec @ state.a))), max(float(f_vec @ rf), 1e-10)
    return rf, f, q, *beta_of(f, q)


def observe(state: State, prior: tuple, y: float, n: float) -> None:
    """Update the state in place with y of n; prior is prior_of() the state."""
    rf, f, q, alpha, beta = prior
    da, ta, _ = polygammas(alpha + y)
    db, tb, _ = polygammas(beta + n - y)
    state.a = state.a + rf * ((da - db - f) / q)
    state.r = state.r - np.outer(rf, rf) * ((1 - (ta + tb) / q) / q)


def filtered(y: np.ndarray, n: np.ndarray, x: np.ndarray, design: Design, state: State, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step forecasts, and the means and variances after each row; state is left as after the last.

    A row with n = 0 (or NaN y) only evolves. extra: further trials with the same answer as y.
    """
    g, scale = design.evolution()
    still = bool((g == np.eye(design.size)).all() and (scale == 1).all())
    vectors = design.vectors(x)
    p, m, v = np.empty(len(y)), np.empty((len(y), design.size)), np.empty((len(y), design.size))
    for t, f_vec in enumerate(vectors):
        prior = prior_of(state, f_vec)
        p[t] = prior[3] / (prior[3] + prior[4])
        if n[t] > 0 and y[t] == y[t]:
            observe(state, prior, y[t], max(n[t], y[t]))
            if extra is not None and extra[t] > 0:
                observe(state, prior_of(state, f_vec), extra[t] * y[t], extra[t])
        m[t], v[t] = state.a, np.diag(state.r)
        if not still:
            state.a = g @ state.a
            state.r = g @ state.r @ g.T / scale
            state.r = (state.r + state.r.T) / 2
    return p, m, v


@dataclass
class Series:
    """One series: answers y of n, further trials with the same answer, regressors, and the state it begins from."""

    y: np.ndarray
    n: np.ndarray
    x: np.ndarray
    state: State
    extra: np.ndarray | None = None


def filtered_together(series: list[Series], design: Design, path: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """filtered() of each series, all at once: at a step, those that are that long. States are left as after the last rows.

    Without path, means and variances are those after each series' last row only.
    """
    order = sorted(range(len(series)), key=lambda i: -len(series[i].y))
    longest = [len(series[i].y) for i in order]
    g, scale = design.evolution()
    still = bool((g == np.eye(design.size)).all() and (scale == 1).all())
    a, r = np.stack([series[i].state.a for i in order]), np.stack([series[i].state.r for i in order])
    top = max(longest, default=0)
    y, n, extra = np.full((3, len(order), top), np.nan)
    vectors = np.zeros((len(order), top, design.size))
    for k, i in enumerate(order):
        own, size = series[i], longest[k]
        y[k, :size], n[k, :size], vectors[k, :size] = own.y, own.n, design.vectors(own.x)
        extra[k, :size] = 0 if own.extra is None else own.extra
    p, (m, v) = np.empty((len(order), top)), np.empty((2, len(order), top if path else min(top, 1), design.size))
    alive = len(order)

    def prior(at: np.ndarray, t: int):
        f_vec = vectors[at, t]
        rf = (r[at] @ f_vec[:, :, None])[:, :, 0]
        f, q = np.clip((f_vec * a[at]).sum(axis=1), -WIDEST, WIDEST), np.maximum((f_vec * rf).sum(axis=1), 1e-10)
        return rf, f, q, *betas_of(f, q)

    def learn(at: np.ndarray, found: tuple, hits: np.ndarray, trials: np.ndarray) -> None:
        rf, f, q, alpha, beta = found
        if ((trials == 1) & ((hits == 0) | (hits == 1))).all():  # psi and psi' of x + 1 are those of x with 1 / x and - 1 / x^2
            step = np.where(hits == 1, 1 / alpha, -1 / beta)
            a[at] += rf * (step / q)[:, None]
            r[at] -= rf[:, :, None] * rf[:, None, :] * ((step / q) ** 2)[:, None, None]
            return
        (da, db), (ta, tb) = (x.reshape(2, -1) for x in polygammas_of(np.concatenate((alpha + hits, beta + trials - hits)))[:2])
        a[at] += rf * ((da - db - f) / q)[:, None]
        r[at] -= rf[:, :, None] * rf[:, None, :] * ((1 - (ta + tb) / q) / q)[:, None, None]

    for t in range(top):
        while longest[alive - 1] <= t:
            alive -= 1
        every = np.arange(alive)
        found = prior(every, t)
        p[:alive, t] = found[3] / (found[3] + found[4])
        at = np.flatnonzero((n[:alive, t] > 0) & ~np.isnan(y[:alive, t]))
        if len(at):
            learn(at, tuple(x[at] for x in found), y[at, t], np.maximum(n[at, t], y[at, t]))
            at = at[extra[at, t] > 0]
            if len(at):
                learn(at, prior(at, t), extra[at, t] * y[at, t], extra[at, t])
        at = t if path else 0
        m[:alive, at], v[:alive, at] = a[:alive], np.diagonal(r[:alive], axis1=1, axis2=2)
        if not still:
            a[:alive] = a[:alive] @ g.T
            r[:alive] = g @ r[:alive] @ g.T / scale
            r[:alive] = (r[:alive] + r[:alive].transpose(0, 2, 1)) / 2
    out: list = [None] * len(order)
    for k, i in enumerate(order):
        series[i].state.a, series[i].state.r = a[k], r[k]
        out[i] = p[k, : longest[k]], m[k, : longest[k]], v[k, : longest[k]]
    return out


def _kinds(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in names)


def by_series(rows: DataFrame, keys: list[str], order: list[str], schema: str, fit: Callable[[list[pd.DataFrame]], Iterable[pd.DataFrame]], tasks: int | None = None) -> DataFrame:
    """fit() over lists of whole series, each a frame of rows with equal keys in order; nulls are a key and come first in order.

    What fit gives is handed over as it comes, some HANDED rows at once: Python and the JVM hold a
    whole batch each. tasks: so many, for series of few bytes and much work.
    """

    def handed(made: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for frame in made:
            part.append(frame)
            size += len(frame)
            if size >= HANDED:
                yield pd.concat(part, ignore_index=True)
                part, size = [], 0
        if part:
            yield pd.concat(part, ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, ready, size = None, [], 0
        for frame in frames:
            frame = frame if tail is None else pd.concat((tail, frame), ignore_index=True)
            if frame.empty:
                continue
            number = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            parts = np.split(np.arange(len(frame)), np.flatnonzero(number[1:] != number[:-1]) + 1)
            tail = frame.iloc[parts[-1]]
            for part in parts[:-1]:
                ready.append(frame.iloc[part])
                size += len(part)
                if len(ready) >= TOGETHER or size >= ROWS:
                    yield from handed(fit(ready))
                    ready, size = [], 0
        if tail is not None:
            yield from handed(fit([*ready, tail]))

    return rows.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _started(rows: DataFrame, keys: list[str], states: DataFrame | None) -> DataFrame:
    """rows with _a and _r, and first in each series that states(keys, a, r) has, a row without a slot that holds them."""
    if states is None:
        return rows
    own = rows.withColumns({c: F.lit(None).cast("array<double>") for c in ("_a", "_r")})
    return own.unionByName(states.select(*keys, F.col("a").alias("_a"), F.col("r").alias("_r")), allowMissingColumns=True)


def _opened(frame: pd.DataFrame, size: int, variance: float) -> tuple[pd.DataFrame, State]:
    """A series without its state row, and the state it begins from."""
    if "_a" in frame and len(frame) and isinstance(first := frame["_a"].iloc[0], (list, np.ndarray)):
        return frame.iloc[1:], State(np.array(first, float), np.array(frame["_r"].iloc[0], float).reshape(size, size))
    return frame, State.prior(size, variance)


def _closed(frame: pd.DataFrame, m: np.ndarray, v: np.ndarray, state: State) -> pd.DataFrame:
    """frame with m and v, and at the last row a and r; m and v of one row are the last row's."""
    last = [None] * max(0, len(frame) - 1)
    means = dict(m=list(m), v=list(v)) if len(m) == len(frame) else dict(m=[*last, *m], v=[*last, *v])
    return frame.assign(**means, a=[*last, state.a][: len(frame)], r=[*last, state.r.ravel()][: len(frame)]).astype(dict.fromkeys("mvar", object))


_STATE = "m array<double>, v array<double>, a array<double>, r array<double>"


def group_models(rows: DataFrame, keys: list[str], features: list[str], per_day: int, daily: int = 1, weekly: int = 1, variance: float = 10.0, discounts: tuple[float, float, float] = (1.0, 1.0, 1.0), states: DataFrame | None = None) -> DataFrame:
    """(keys, slot, p_hat, y, n, m, v, a, r): a dynamic model of y out of n for each key, in slot order.

    a and r, the state after the last row with its whole covariance, are null in all other rows.
    states (keys, a, r), as last_states() gives them, are gone on from; other series begin from the prior.
    """
    design = Design(len(features), True, [(per_day, daily), (7 * per_day, weekly)], *discounts)

    def fit(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
        opened = [_opened(f, design.size, variance) for f in frames]
        series = []
        for frame, state in opened:
            y, n = frame["y"].to_numpy(float), frame["n"].to_numpy(float)
            series.append(Series(y, np.where(n > 0, np.maximum(n, y), 0), frame[features].to_numpy(float).reshape(len(frame), len(features)), state))
        out = []
        for (frame, _), own, (p, m, v) in zip(opened, series, filtered_together(series, design), strict=True):
            out.append(_closed(frame[[*keys, "slot"]].assign(p_hat=p, y=own.y, n=frame["n"].to_numpy(float)), m, v, own.state))
        return out

    schema = f"{_kinds(rows, keys)}, slot long, p_hat double, y double, n double, {_STATE}"
    return by_series(_started(rows.select(*keys, "slot", "y", "n", *features), keys, states), keys, ["slot"], schema, lambda f: fit(f))


def agent_models(rows: DataFrame, keys: list[str], features: list[str], upweight: int | None = None, whole_weights: bool = False, variance: float = 50.0, states: DataFrame | None = None, path: bool = True, bare: bool = False, ends: bool = False) -> DataFrame:
    """(keys, od, slot, p_hat, y, m, v, a, r): a static sequential logistic model for each key over rows in (slot, od) order.

    A row teaches if update is true. upweight names the rare answer: its rows count as weight
    trials (rounded down with whole_weights). a, r and states: as in group_models(); with states, rows
    are the tail that an earlier run has not seen. Without path, m and v too are null but in last rows; bare: there are none of m, v, a and r.
    ends: only each series' last row is handed over.
    """
    design = Design(len(features))

    def fit(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
        opened = [_opened(f, design.size, variance) for f in frames]
        series = [_agent_series(frame, features, state, upweight, whole_weights) for frame, state in opened]
        made = zip(opened, series, filtered_together(series, design, path and not bare and not ends), strict=True)
        if ends:
            made = [(f.iloc[-1:], state, own, x) for (f, state), own, x in made]
            return [_closed(f[[*keys, "od", "slot"]].assign(p_hat=p[-1:], y=own.y[-1:]), m[-1:], v[-1:], own.state) for f, _, own, (p, m, v) in made]
        if bare:
            return [frame[[*keys, "od", "slot"]].assign(p_hat=p, y=own.y) for (frame, _), own, (p, _, _) in made]
        return [_closed(frame[[*keys, "od", "slot"]].assign(p_hat=p, y=own.y), m, v, own.state) for (frame, _), own, (p, m, v) in made]

    names = dict.fromkeys([*keys, "od", "slot", "y", "weight", "update", *features])
    schema = f"{_kinds(rows, keys)}, od long, slot long, p_hat double, y double" + f", {_STATE}" * (not bare)
    return by_series(_started(rows.select(*names), keys, states), keys, ["slot", "od"], schema, lambda f: fit(f))


def _agent_series(frame: pd.DataFrame, features: list[str], state: State, upweight: int | None, whole: bool, update: np.ndarray | None = None) -> Series:
    y = frame["y"].to_numpy(float)
    n = (frame["update"].to_numpy(bool) if update is None else update).astype(float)
    extra = None
    if upweight is not None:
        extra = np.where(y == upweight, np.maximum(0, frame["weight"].astype(float).fillna(1).to_numpy() - 1), 0)
        extra = np.floor(extra) if whole else extra
    return Series(y, n, frame[features].to_numpy(float).reshape(len(frame), len(features)), state, extra)


def oam_and_pm(rows: DataFrame, keys: list[str], pm_features: list[str], oam_features: list[str], end_of_training: int, upweight_pm: int | None = None, upweight_oam: int | None = None, variance: float = 50.0, carried: tuple[str, ...] = (), bare: bool = False) -> DataFrame:
    """(keys, od, carried, slot, y, p_pm, p_oam, t): the frozen prior model and the model that keeps learning, for each key.

    PM learns from rows up to end_of_training, inclusive, and then only forecasts, from its own
    (frozen) features; OAM goes on from PM's state with its features. t is OAM's last mean over
    its standard deviation; bare: there is none. carried: columns of rows that go along as they are.
    """
    design, along = Design(len(pm_features)), ["od", *carried, "slot"]

    def fit(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = [(f["slot"] > end_of_training).to_numpy() for f in frames]
        first = [_agent_series(f, pm_features, State.prior(design.size, variance), upweight_pm, False, ~late) for f, late in zip(frames, after, strict=True)]
        pm = filtered_together(first, design, path=False)
        tails = [i for i, late in enumerate(after) if late.any()]
        second = [_agent_series(frames[i][after[i]], oam_features, first[i].state, upweight_oam, True, np.ones(int(after[i].sum()), bool)) for i in tails]
        oam = dict(zip(tails, filtered_together(second, design, path=False) if second else [], strict=True))
        for i, (frame, (p_pm, m, v)) in enumerate(zip(frames, pm, strict=True)):
            p_oam = p_pm.copy()
            if i in oam:
                p_oam[after[i]], m, v = oam[i]
            own = frame[[*keys, *along]].assign(y=first[i].y, p_pm=p_pm, p_oam=p_oam)
            yield own if bare else own.assign(t=[m[-1] / np.sqrt(np.maximum(v[-1], 1e-300))] * len(frame))

    schema = f"{_kinds(rows, [*keys, *along])}, y double, p_pm double, p_oam double" + ", t array<double>" * (not bare)
    names = dict.fromkeys([*keys, *along, "y", "weight", *pm_features, *oam_features])
    return by_series(rows.select(*names), keys, ["slot", "od"], schema, lambda f: fit(f))


def last_states(models: DataFrame, keys: list[str], states: DataFrame | None = None) -> DataFrame:
    """(keys, slot, m, v, a, r) of each series' last row: what a table keeps, and what `states` of a later run takes.

    states: those that models went on from; a series without new rows keeps its own.
    """
    own = models.filter("r is not null").select(*keys, "slot", "m", "v", "a", "r")
    if states is None:
        return own
    new = own.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [states[k].eqNullSafe(new[f"_{k}"]) for k in keys]
    return own.unionByName(states.join(new, same, "left_anti").select(own.columns))
