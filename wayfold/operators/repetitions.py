"""Calibration runs of whole agents in numpy: swapped days, seeded injections, and the factor at the end of the axis.

A task has an agent's zones as one array and makes all its repetitions beside it, so a run is
never a row of a table. Candidates are drawn from the same MD5s as operators.inject draws from; a
candidate is left as soon as no choice of its other days can make it pass. A repetition's regular
and injected run have the same slots up to the end of training, so that part is learned once.
The steps are those of plans.detection.verdicts(), of which only the factor is asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from wayfold.operators import dglm
from wayfold.operators.kernel import offsets

#: Repetitions whose runs are filtered side by side, and whose rows are made together; candidates that are drawn at once, and messages that are hashed at once.
TOGETHER, PART, DRAWN, HASHED = 2048, 128, 200_000, 4096

_TURNS = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4] for i in range(64)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, (7 * i) % 16)[i // 16] for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def draws(messages: np.ndarray) -> np.ndarray:
    """The number in [0, 1) that inject.draw() makes of each message (bytes without zeros, 55 at most)."""
    out = np.empty(len(messages))
    for at in range(0, len(messages), HASHED):
        out[at : at + HASHED] = _hashed(messages[at : at + HASHED])
    return out


def _hashed(messages: np.ndarray) -> np.ndarray:
    n, width = len(messages), messages.dtype.itemsize
    size = np.strings.str_len(messages)
    if size.max(initial=0) > 55:
        raise ValueError("a message of over 55 bytes")
    block = np.zeros((n, 64), np.uint8)
    block[:, :width] = np.ascontiguousarray(messages).view(np.uint8).reshape(n, width)
    block[np.arange(n), size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = size * 8
    a, b, c, d, f, g = (np.full(n, x) for x in (*_START, *_START[:2]))
    for i in range(64):
        if i < 32:  # d ^ (b & (c ^ d)), then c ^ (d & (b ^ c))
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[_WORDS[i]], out=f)
        np.add(f, _SINES[i], out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high, low = (a + _START[0]).byteswap().astype(np.uint64), (b + _START[1]) & np.uint32(0xFF)
    return ((high << np.uint64(8)) | low).astype(float) / float(1 << 40)


@dataclass(frozen=True)
class Injection:
    threshold: float = 0.175
    tries: int = 1000
    min_stay: int = 12
    max_shift: int = 60


def triplets(day: np.ndarray, min_stay: int) -> list[tuple[int, int, int, int]]:
    """sequence.sps_triplets() of one day's zones, -1 where there is none: (s1_start, s1_end, s2_start, s2_end) from the day's begin."""
    edges = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), len(day)]
    stays = [(s, e) for s, e in zip(edges, edges[1:]) if e - s >= min_stay and day[s] >= 0]
    out = []
    for i, (s, e) in enumerate(stays):
        later = next((x for x in stays[i + 1 : i + 3] if x[0] > e), None)
        if later:
            out.append((s, e, *later))
    return out


def moved(day: np.ndarray, triplet: tuple[int, int, int, int], early: bool, d: int) -> np.ndarray:
    """The day as inject.injected() leaves it."""
    s1, p0, p1, e2 = triplet
    out = day.copy()
    if d and early:
        out[p0 - d : p1 - d], out[p1 - d : p1] = day[p0:p1], day[p1]
    elif d:
        out[p0 + d : p1 + d], out[p0 : p0 + d] = day[p0:p1], day[p0 - 1]
    return out


class Choices:
    """What each choice on each day of some agents' zones (agents, days, per_day) would change."""

    def __init__(self, days: np.ndarray, how: Injection):
        self.days, self.how, self.all, self.most, rows = days, how, [], [], []
        agents, n, _ = days.shape
        self.first, self.number, self.best = np.zeros((agents, n), int), np.zeros((agents, n), int), np.zeros((agents, n), int)
        reach = min(how.max_shift, days.shape[2])
        for a in range(agents):
            for b in range(n):
                found = triplets(days[a, b], how.min_stay)
                self.first[a, b], self.number[a, b] = len(self.all), len(found)
                for t in found:
                    most = (min(how.max_shift, t[3] - t[2]), min(how.max_shift, t[1] - t[0]))
                    table = np.full((2, reach + 1), -1)
                    for early in (0, 1):
                        low = 1 if early else math.floor(most[0] * 0.7)
                        for d in range(low, most[early] + 1):
                            table[early, d] = int((moved(days[a, b], t, bool(early), d) != days[a, b]).sum())
                    self.all.append(t)
                    self.most.append(most)
                    rows.append(table)
                    self.best[a, b] = max(self.best[a, b], table.max())
        self.table = np.array(rows).reshape(len(rows), 2, reach + 1)
        self.most = np.array(self.most, int).reshape(len(rows), 2)
        self.bound = np.maximum(self.table.max(axis=2), 0) if len(rows) else np.zeros((0, 2), int)


def searched(choices: Choices, agent: np.ndarray, source: np.ndarray, prefix: np.ndarray, first_day: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(success, attempt) of each key as inject.inject_until() finds them; attempt is the first that passes, else the last.

    agent: a key's place in choices; source (keys, days): whose zones its window's days have; prefix:
    what its draws' messages begin with; size: its slots in the window.
    """
    how, keys = choices.how, len(agent)
    best = np.take_along_axis(choices.best[agent], source, axis=1)
    order = np.argsort(-best, axis=1, kind="stable")
    rest = np.take_along_axis(best, order, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1]
    rest = np.concatenate((rest, np.zeros((keys, 1), int)), axis=1)
    least = np.array([next((c for c in range(s + 2) if c / s > how.threshold), s + 1) if s else 1 for s in range(int(size.max(initial=0)) + 1)])[size]
    tried = np.array([f"{i}|".encode() for i in range(how.tries)])
    named = [np.array([f"{first_day + w}|{c}".encode() for w in range(source.shape[1])]) for c in (1, 2, 3)]

    def drawn(k: np.ndarray, a: np.ndarray, day: np.ndarray, c: int) -> np.ndarray:
        return draws(np.strings.add(np.strings.add(prefix[k], tried[a]), named[c - 1][day]))

    def totals(k: np.ndarray, a: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, attempt, slots changed) of the candidates that change `need` at least."""
        sums = np.zeros(len(k), int)
        for i in range(source.shape[1]):
            day = order[k, i]
            at = choices.first[agent[k], source[k, day]]
            n = choices.number[agent[k], source[k, day]]
            some = np.flatnonzero(n > 0)
            if not len(some):
                break  # days without any come last
            pick = np.zeros(len(k), int)
            many = np.flatnonzero(n > 1)
            pick[many] = np.floor(drawn(k[many], a[many], day[many], 1) * n[many])
            at = at + pick
            early = np.zeros(len(k), int)
            early[some] = drawn(k[some], a[some], day[some], 2) < 0.5
            bound = np.zeros(len(k), int)
            bound[some] = choices.bound[at[some], early[some]]
            go = sums + bound + rest[k, i + 1] >= need
            k, a, need, sums, day, at, early, n = (x[go] for x in (k, a, need, sums, day, at, early, n))
            some = np.flatnonzero(n > 0)
            most = choices.most[at[some], early[some]]
            low = np.where(early[some] == 1, 1, np.floor(most * 0.7)).astype(int)
            shift = low + np.floor(drawn(k[some], a[some], day[some], 3) * (most - low + 1)).astype(int)
            sums[some] += choices.table[at[some], early[some], shift]
            go = sums + rest[k, i + 1] >= need
            k, a, need, sums = (x[go] for x in (k, a, need, sums))
        go = sums >= need
        return k[go], a[go], sums[go]

    attempt, success = np.full(keys, how.tries - 1), np.zeros(keys, bool)
    pending = np.flatnonzero((size > 0) & (rest[:, 0] >= least))
    start, step = 0, 8
    while start < how.tries and len(pending):
        stop = min(how.tries, start + step)
        few = max(1, DRAWN // (stop - start))
        for at in range(0, len(pending), few):
            own = pending[at : at + few]
            k, a, _ = totals(np.repeat(own, stop - start), np.tile(np.arange(start, stop), len(own)), np.repeat(least[own], stop - start))
            found, where = np.unique(k, return_index=True)  # candidates are in order of key and attempt
            attempt[found], success[found] = a[where], True
        pending = pending[~success[pending]]
        start, step = stop, 5 * step
    last = np.flatnonzero((size > 0) & ~success & (rest[:, 0] >= how.threshold * size * (1 - 1e-9)))
    k, _, c = totals(last, np.full(len(last), how.tries - 1), np.zeros(len(last), int))
    success[k] = c / size[k] >= how.threshold
    return success, attempt


def injected_days(choices: Choices, agent: np.ndarray, source: np.ndarray, prefix: np.ndarray, attempt: np.ndarray, first_day: int) -> np.ndarray:
    """The window's days (keys, days, per_day) of each key after its attempt."""
    out = choices.days[agent[:, None], source]
    k, w = np.nonzero(choices.number[agent[:, None], source])
    b = source[k, w]
    n, own = choices.number[agent[k], b], np.strings.add(prefix[k], np.array([f"{i}|".encode() for i in range(choices.how.tries)])[attempt[k]])
    x = [draws(np.strings.add(own, np.array([f"{first_day + i}|{c}".encode() for i in range(source.shape[1])])[w])) for c in (1, 2, 3)]
    at, early = choices.first[agent[k], b] + np.floor(x[0] * n).astype(int), (x[1] < 0.5).astype(int)
    most = choices.most[at, early]
    low = np.where(early == 1, 1, np.floor(most * 0.7)).astype(int)
    shift = low + np.floor(x[2] * (most - low + 1)).astype(int)
    for i, j, choice, side, d in zip(k.tolist(), w.tolist(), at.tolist(), early.tolist(), shift.tolist(), strict=True):
        out[i, j] = moved(out[i, j], choices.all[choice], bool(side), d)
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-9, 1 - 1e-9)
    return np.clip(np.log(q / (1 - q)), -10, 10)


class Factors:
    """The factor at the end of the axis of many runs, over the group's cube (slot, origin, dest) with NaN where it has no cell.

    Rows are made for PART repetitions at once, whose arrays stay in the processor's cache, and filtered for all of them
    together. What an injection after training leaves as it was, the rows of training, is made once.
    """

    def __init__(self, cube: np.ndarray, setup, variance: float = 50.0):
        self.setup, self.size, self.variance = setup, 5, variance
        one = np.nan_to_num(cube)
        two = np.zeros_like(one)
        two[1:] = one[:-1] @ one[1:]  # at a slot: the moves into the one before it and into it
        self.cubes, self.zones = (one.ravel(), two.ravel()), cube.shape[1]

    def of(self, runs: np.ndarray) -> np.ndarray:
        """log_l of each run's zones (runs, slots), -1 where there is none; NaN without a move. The later half are the runs that the first half become by an injection after training."""
        half, out = len(runs) // 2, np.empty(len(runs))
        cuts = [(at, min(at + PART, half)) for at in range(0, half, PART)]
        parts = [self._rows(np.concatenate((runs[a:b], runs[half + a : half + b]))) for a, b in cuts]
        self._forecasts(parts)
        made, at = self._ends(parts), 0
        for a, b in cuts:
            out[a:b], out[half + a : half + b] = made[at : at + b - a], made[at + b - a : at + 2 * (b - a)]
            at += 2 * (b - a)
        return out

    def _rows(self, z: np.ndarray) -> dict:
        """Asked cells of some runs, those of training for the first half only: by run, slot and destination, with features."""
        setup, n, z = self.setup, self.zones, z.astype(np.int32)
        end, (count, slots) = setup.end_of_training, z.shape
        half = count // 2
        here = z >= 0
        filled = np.maximum.accumulate(np.where(here, np.arange(slots, dtype=np.int32), -1), axis=1)
        origin = np.full((count, slots), -1, np.int32)
        origin[:, 1:] = np.where(filled[:, :-1] >= 0, np.take_along_axis(z, np.maximum(filled[:, :-1], 0), axis=1), -1)
        move = here & (origin >= 0)
        # pairs: order of first use, uses in training, kinds of zone
        mr, mt = np.nonzero(move)
        mo, mz = origin[mr, mt], z[mr, mt]
        code = (mr * n + mo) * n + mz
        first = np.full(count * n * n, slots + 1)
        first[code[::-1]] = mt[::-1]  # the last that is written is the earliest
        first = first.reshape(count, n, n)
        taken = np.bincount(code[mt < end], minlength=count * n * n).reshape(count, n, n)
        seen, staying = np.zeros((2, count * n), bool)
        training = z[:, : end + 1]
        edge = np.ones((count, end + 2), bool)
        edge[:, 1:-1] = training[:, 1:] != training[:, :-1]
        at = np.flatnonzero(edge)  # where stays begin, and each run's end
        r, t = at // (end + 2), at % (end + 2)
        stay = np.flatnonzero((t <= end) & (training[r, np.minimum(t, end)] >= 0))
        zone = r[stay] * n + training[r[stay], t[stay]]
        seen[zone] = True
        staying[zone[at[stay + 1] - at[stay] >= setup.min_stay]] = True
        order = np.argsort(first, axis=2, kind="stable")  # by rank: the destination
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n), order.shape), axis=2)
        valid = (taken > setup.min_taken) & seen.reshape(count, n)[:, :, None]
        rank, valid = rank.reshape(-1, n), valid.reshape(-1, n)
        # rows
        own = np.flatnonzero((mr < half) | (mt > end))
        mr, mt, mz, ro = mr[own], mt[own], mz[own], mr[own] * n + mo[own]
        made = rank[ro, mz]
        asked = np.flatnonzero(valid[ro] & (rank[ro] <= made[:, None]))
        m, d = asked // n, asked % n
        r, t, so = mr[m], mt[m], ro[m]
        pair = so * n + d
        o, j = so - r * n, rank.ravel()[pair]
        y = mz[m] == d
        kind = np.where(staying[so], (o != d).astype(np.int64), 2)
        x = np.zeros((4, len(m)))  # kernel_prob, lag1, lag2, gate
        for c, (k, cube) in enumerate(zip((1, 2), self.cubes, strict=True), 1):
            was = np.where(mt >= k, z[mr, np.maximum(mt - k, 0)], -1)
            base = np.where(was >= 0, (mt * n + was) * n, -1)[m]
            p = np.where(base >= 0, cube[np.maximum(base, 0) + d], 0.0)
            before = np.zeros((n, len(mr)))
            before[j, m] = p
            total = np.zeros(len(mr))
            for i in range(n):
                before[i], total = total, total + before[i]
            x[c] = np.clip(p / np.maximum(1 - before[j, m], 1e-12), 0.0, 1.0)
        late = t > end
        x[0] = self._kernel(pair, t, y, kind == 0, late, half * n * n, count * n * n)
        x[3] = self._gate(so, t, y, kind == 0, late, half * n)
        x[:3] = _logit(x[:3])
        # frozen features: those of the last training day's slot, else even odds and no gate
        series = r * 3 + kind
        day = np.full((half * n * n, setup.per_day), -1, np.int32)
        last = np.flatnonzero(~late & (t > end - setup.per_day))
        per = setup.per_day
        day[pair[last], t[last] % per] = np.arange(len(last))
        rows = np.flatnonzero(late)
        at = day[pair[rows] % (half * n * n), t[rows] % per]
        # series: by run and kind, then slot and destination
        sort = np.argsort(series.astype(np.int16), kind="stable")
        trained = sort[~late[sort]]
        place = np.zeros(len(m), np.int64)
        place[rows] = np.arange(len(rows))
        tested = place[sort[late[sort]]]  # numbered among the late rows
        window = slice(end + 1, slots)
        known = np.zeros(count * n * n)
        return {
            "half": half, "x": x[:, trained], "y": y[trained], "series": series[trained], "cell": pair[trained], "when": t[trained],
            "last_x": x[:, last], "last_series": series[last], "frozen": np.where(at >= 0, at, len(last) + series[rows] % (3 * half)),
            "late_x": x[:, rows[tested]], "late_y": y[rows[tested]], "late_series": series[rows[tested]], "tested": tested,
            "late_cell": so[rows] * n + j[rows], "late_t": t[rows], "rank": rank, "known": known,
            "move": move[:, window], "any": move.any(axis=1), "origin": origin[:, window], "z": z[:, window],
            "pairs": (first <= slots).sum(axis=2).reshape(-1), "ranked": np.take_along_axis(valid, order.reshape(-1, n), axis=1),
        }

    def _kernel(self, pair, t, y, stays, late, half, number) -> np.ndarray:
        """kernel_prob: kernel.empirical_probability() of each row's pair. Pairs from `half` on go on from the training of those before."""
        per, out = self.setup.per_day, np.empty(len(pair))
        minutes, days, start = 1440 / per, -(-self.setup.slots // per), (self.setup.end_of_training + 1) // per

        def laid(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """There and one (days, pairs, per_day) of these rows' pairs, and the rows' cells."""
            used = np.zeros(number, bool)
            used[pair[own]] = True
            names = np.flatnonzero(used)
            at = np.cumsum(used) - 1
            cell = (t[own] // per * len(names) + at[pair[own]]) * per + t[own] % per
            there, one = np.zeros((2, days, len(names), per), np.uint8)
            there.ravel()[cell], one.ravel()[cell] = 1, y[own]
            again = np.flatnonzero((names >= half) & used[names - half])
            for v in (there, one):
                v[:start, again] = v[:start, at[names[again] - half]]
            return there, one, cell

        own = np.flatnonzero(stays)
        there, one, cell = laid(own)
        bins, reach = max(1, round(15 / minutes)), max(1, round(90 / minutes))
        spread = sum(math.exp(-((dist / bins) ** 2)) * np.roll(np.eye(per), s, axis=1) for s, dist in offsets(per, reach))
        fade, sums = math.exp(-1 / 14.0), []
        for v in (one, there):
            v = (v.reshape(-1, per).astype(float) @ spread).reshape(v.shape)
            total = np.zeros(v.shape)
            for k in range(1, days):
                np.add(total[k - 1], v[k - 1], out=total[k])
                total[k] *= fade
            sums.append(total.ravel()[cell])
        out[own] = (0.5 + sums[0]) / (1 + sums[1])
        own = np.flatnonzero(~stays)
        there, one, cell = laid(own)
        reach, sums = max(0, round(60 / minutes)), []
        for v in (one, there):
            v = np.bitwise_or.reduce([np.roll(v, s, axis=2) for s, _ in offsets(per, reach)])
            total = np.zeros(v.shape, np.int16)
            for k in range(1, days):
                np.add(total[k - 1], v[k - 1], out=total[k])
            sums.append(total.ravel()[cell])
        out[own] = (0.5 + sums[0]) / (1.0 + sums[1])
        return out

    def _gate(self, so, t, y, stays, late, half) -> np.ndarray:
        """gate: sequence.signed_leave_gate() of the pair's row before. Series from `half` on go on from the training of those before."""
        setup, out = self.setup, np.zeros(len(so))
        own = np.flatnonzero(stays)
        again = own[~late[own]]
        rows = np.concatenate((again, own))
        series = np.concatenate((so[again] + half, so[own]))
        sort = np.argsort(series.astype(np.int16), kind="stable")
        rows, series = rows[sort], series[sort]
        if not len(rows):
            return out
        hit, slot = y[rows], t[rows]
        same = np.concatenate(([False], series[1:] == series[:-1]))
        run_on = same & np.concatenate(([False], (slot[1:] == slot[:-1] + 1) & hit[:-1]))
        at = np.arange(len(rows))
        length = at - np.maximum.accumulate(np.where(run_on, 0, at)) + 1  # of the run of hits that ends in a row
        before = np.zeros(len(rows))
        before[1:] = np.where(run_on[1:], length[:-1], 0)
        done = ~hit & (before > 0)
        which = np.flatnonzero(done)
        count = np.cumsum(done)  # runs done so far, in all series
        begin = np.maximum.accumulate(np.where(same, 0, at))  # of each row's series
        number = count - (count - done)[begin]  # runs done so far in the row's own series
        total, weight = np.zeros((2, len(which) + 1))
        nth = number[which] - 1
        turn = np.argsort(nth.astype(np.int16), kind="stable")
        for k in np.split(turn, np.cumsum(np.bincount(nth))[:-1]) if len(which) else ():
            go = nth[k[0]] > 0
            total[k + 1] = (total[k] * setup.decay if go else 0.0) + before[which[k]]
            weight[k + 1] = (weight[k] * setup.decay if go else 0.0) + 1.0
        have = number > 0
        mean = total[count] / np.where(have, weight[count], 1.0)
        run = np.where(hit, before + 1, before)
        gate = np.where(have & (np.round(run - (mean - setup.gate_threshold), 9) > 0), -1.0, 0.0)
        out[rows[1:]] = np.where(same[1:], gate[:-1], 0.0)
        out[rows[0]] = 0.0
        return out

    def _forecasts(self, parts: list[dict]) -> None:
        """p_pm and p_oam of each part's rows, as dglm.oam_and_pm() makes them: 'known', the last of training by pair and rank, and 'late' (2, rows)."""
        size = self.size
        base = np.cumsum([0, *(p["half"] for p in parts)])

        def joined(name: str, axis: int = -1) -> np.ndarray:
            return np.concatenate([p[name] for p in parts], axis=axis)

        def dealt(series: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Series of these rows from the longest on, how many are that long at each step, and each row's place, step by step."""
            edges = np.flatnonzero(np.concatenate(([True], series[1:] != series[:-1])))
            lengths = np.diff(np.append(edges, len(series)))
            longest = np.argsort(-lengths, kind="stable")
            at = np.empty_like(longest)
            at[longest] = np.arange(len(longest))
            alive = np.cumsum(np.bincount(lengths)[::-1])[::-1][1:]
            offset = np.cumsum(alive) - alive
            step = np.arange(len(series)) - np.repeat(edges, lengths)
            return series[edges][longest], alive, offset[step] + np.repeat(at, lengths)

        def laid(x: np.ndarray, place: np.ndarray) -> np.ndarray:
            out = np.empty((size, x.shape[1]))
            out[0] = 1.0
            for i, v in enumerate(x, 1):
                out[i, place] = v
            return out

        trained = np.concatenate([p["series"] + 3 * 2 * b for p, b in zip(parts, base, strict=False)])
        a, v = np.zeros((size, 6 * base[-1] + 1)), np.zeros((size, size, 6 * base[-1] + 1))  # the last: a series without training
        for i in range(size):
            v[i, i] = self.variance
        if len(trained):
            names, alive, place = dealt(trained)
            own, var = np.zeros((size, len(names))), np.repeat((np.eye(size) * self.variance)[:, :, None], len(names), axis=2)
            y = np.empty(len(place), bool)
            y[place] = joined("y")
            made = _filtered(laid(joined("x"), place), y, alive, own, var)[place]
            a[:, names], v[:, :, names] = own, var
            at = 0
            for p in parts:
                k = len(p["series"])
                turn = np.argsort(p["when"].astype(np.int16), kind="stable")
                cell = p["cell"][turn]
                cell = cell // self.zones * self.zones + p["rank"].ravel()[cell]
                for side in (0, len(p["known"]) // 2):
                    p["known"][cell + side] = made[at : at + k][turn]  # the last that is written is the latest
                at += k
        late = np.concatenate([p["late_series"] + 3 * 2 * b for p, b in zip(parts, base, strict=False)])
        made = np.empty(0)
        if len(late):
            names, alive, place = dealt(late)
            half = np.repeat([3 * p["half"] for p in parts], [6 * p["half"] for p in parts])
            begin = np.repeat([6 * b for b in base[:-1]], [6 * p["half"] for p in parts])
            old = names - np.where(names - begin[names] >= half[names], half[names], 0)
            own, var = a[:, old], v[:, :, old]
            y = np.empty(len(place), bool)
            y[place] = joined("late_y")
            made = _filtered(laid(joined("late_x"), place), y, alive, own, var)[place]
        at = 0
        for p, b in zip(parts, base, strict=False):
            k = len(p["late_series"])
            p["late"] = np.empty((2, k))
            p["late"][1, p["tested"]] = made[at : at + k]
            at += k
            # the frozen model: forecasts of the last day's rows, and of rows that have none there
            all_ = 6 * b + np.arange(3 * p["half"])
            x = np.zeros((size, len(p["last_series"]) + len(all_)))
            x[0], x[1:, : len(p["last_series"])] = 1.0, p["last_x"]
            old = np.concatenate((6 * b + p["last_series"], all_))
            alpha, beta = _betas(*_moments(x, a[:, old], v[:, :, old])[1:])
            p["late"][0] = (alpha / (alpha + beta))[p["frozen"]]

    def _ends(self, parts: list[dict]) -> np.ndarray:
        """log_l: running sums of the test slots' log factors less the largest before the last; those of training are 0."""
        end, slots, n = self.setup.end_of_training, self.setup.slots, self.zones
        joined = lambda name, axis=0: np.concatenate([p[name] for p in parts], axis=axis)
        first = joined("known").reshape(-1, n).T  # by rank: a pair with a model has a last forecast of training, others 0
        known, size = np.repeat(first[:, None], 2, axis=1), first.shape[1]
        flat = known.reshape(-1)
        base = np.cumsum([0, *(len(p["known"]) for p in parts)])
        cell, late = np.concatenate([p["late_cell"] + b for p, b in zip(parts, base, strict=False)]), joined("late", 1)
        t = joined("late_t") - end - 1
        turn = np.argsort(t.astype(np.int16), kind="stable")
        cuts = np.searchsorted(t[turn], np.arange(slots - end))
        cell = cell % n * (2 * size) + cell // n
        move, origin, z, pairs, rank = (joined(c) for c in ("move", "origin", "z", "pairs", "rank"))
        modelled = joined("ranked").T.copy()
        ranked = modelled.sum(axis=0)
        total, top, log_l = np.zeros(len(move)), np.zeros(len(move)), np.where(joined("any"), 0.0, np.nan)
        for s in range(slots - end - 1):
            at = turn[cuts[s] : cuts[s + 1]]
            flat[cell[at]], flat[cell[at] + size] = late[0, at], late[1, at]
            own = np.flatnonzero(move[:, s])
            if not len(own):
                continue
            here, k = own * n + origin[own, s], np.arange(len(own))
            whole, taken = ranked[here], rank[here, z[own, s]]
            shares, left, gone = np.empty((n, 2, len(own))), np.ones((2, len(own))), np.zeros((2, len(own)))
            for i in range(n):
                c = known[i].take(here, axis=1)
                np.multiply(c, left, out=shares[i])
                gone += shares[i]
                left *= np.subtract(1, c, out=c)
            p = np.where(modelled[taken, here], shares[taken, :, k].T, (1 - gone) / np.maximum(pairs[here] - whole, 1))
            h = np.log(np.maximum(p[0], 1e-12)) - np.log(np.maximum(p[1], 1e-12))
            h[whole == 0] = 0.0  # both sides take the group's cell where no pair has a model
            total[own] += h
            log_l[own] = total[own] - top[own]
            top[own] = np.maximum(top[own], total[own])
        return log_l


def _betas(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dglm.betas_of(): one Newton step for all, from the table, and what curvature adds to it; more where it was not small."""
    la, lb = dglm._near(f, q)
    m, inverse = len(f), 1 / q
    x = np.exp(np.concatenate((la, lb)))
    d, t, u = dglm.polygammas_of(x)
    r = 1 / (x + 4)
    s = r * r
    v = s * r * (2 + r * (3 + r * (2 - s)))  # the third derivative of psi, to some digits
    for i in range(4):
        np.divide(1.0, x + i, out=r)
        np.multiply(r, r, out=s)
        s *= s
        s *= 6.0
        v += s
    r1, r2 = d[:m] - d[m:] - f, (t[:m] + t[m:]) * inverse - 1
    t *= x
    u *= x
    v *= x
    v *= x
    v += u  # second derivatives by the logarithm: this of psi', t of psi
    j11, j12, j21, j22 = t[:m], -t[m:], u[:m] * inverse, u[m:] * inverse
    u *= x
    t = t + u
    with np.errstate(all="ignore"):
        det = 1 / (j11 * j22 - j12 * j21)
        step_a, step_b = (r1 * j22 - r2 * j12) * det, (j11 * r2 - j21 * r1) * det
        aa, bb = step_a * step_a, step_b * step_b
        h1, h2 = 0.5 * (t[:m] * aa - t[m:] * bb), 0.5 * inverse * (v[:m] * aa + v[m:] * bb)
        la -= step_a + (h1 * j22 - h2 * j12) * det
        lb -= step_b + (j11 * h2 - j21 * h1) * det
    alpha, beta = np.exp(la), np.exp(lb)
    more = np.flatnonzero(~((aa < 1e-7) & (bb < 1e-7)))
    if len(more):
        near = (aa[more] < 0.01) & (bb[more] < 0.01)
        for own, begin in ((more[near], lambda i: (la[i], lb[i])), (more[~near], lambda i: dglm._starts(f[i], q[i]))):
            if len(own):
                alpha[own], beta[own] = dglm._newton(f[own], q[own], *begin(own))
    return alpha, beta


def _moments(f_vec: np.ndarray, a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """RF, f and q of dglm.prior_of(), series in the last dimension."""
    rf = (r * f_vec).sum(axis=1)
    return rf, np.clip((a * f_vec).sum(axis=0), -dglm.WIDEST, dglm.WIDEST), np.maximum((rf * f_vec).sum(axis=0), 1e-10)


def _filtered(x: np.ndarray, y: np.ndarray, alive: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Forecasts of dglm.filtered_together() for answers of 0 or 1, by place: x (size, rows) step by step, at each those of
    the first alive[step] series. a (size, series) and r (size, size, series) are left as after the last rows."""
    p, at = np.empty(x.shape[1]), 0
    for m in alive.tolist():
        f_vec, own, var = x[:, at : at + m], a[:, :m], r[:, :, :m]
        rf, f, q = _moments(f_vec, own, var)
        alpha, beta = _betas(f, q)
        p[at : at + m] = alpha / (alpha + beta)
        rf *= np.where(y[at : at + m], 1 / alpha, -1 / beta) / q  # psi and psi' of x + 1 are those of x with 1 / x and - 1 / x^2
        own += rf
        var -= rf[:, None] * rf
        at += m
    return p


def scores(names: list, zones: np.ndarray, cube: np.ndarray, setup, how: Injection, repetitions: int, seed: int) -> list[tuple]:
    """(agent, rep, positive, score) of each agent's repetitions whose injection succeeds; zones (agents, slots), -1 where there is none."""
    per, days = setup.per_day, setup.slots // setup.per_day
    window = setup.test_days
    start = days - window
    base = zones.reshape(len(names), days, per)
    choices = Choices(base, how)
    agent, rep = np.repeat(np.arange(len(names)), repetitions), np.tile(np.arange(repetitions), len(names))
    prefix = np.array([f"{seed}|{a}|{k}|".encode() for a in names for k in range(repetitions)])
    source = np.tile(np.arange(days), (len(agent), 1))
    drawn = draws(np.strings.add(np.repeat(prefix, start), np.tile(np.array([str(e).encode() for e in range(start)]), len(prefix))))
    early = np.argsort(drawn.reshape(len(prefix), start), axis=1, kind="stable")[:, :window]
    swap = np.flatnonzero(rep > 0)
    source[swap, start:] = early[swap]
    source[swap[:, None], early[swap]] = np.arange(start, days)
    there = (base >= 0).sum(axis=2)
    size = np.take_along_axis(there[agent], source[:, start:], axis=1).sum(axis=1)
    success, attempt = searched(choices, agent, source[:, start:], prefix, start, size)
    good, factors, out = np.flatnonzero(success), Factors(cube, setup), []
    for at in range(0, len(good), TOGETHER):
        own = good[at : at + TOGETHER]
        regular = base[agent[own][:, None], source[own]]
        changed = regular.copy()
        changed[:, start:] = injected_days(choices, agent[own], source[own, start:], prefix[own], attempt[own], start)
        made = factors.of(np.concatenate((regular, changed)).reshape(2 * len(own), -1)).reshape(2, -1)
        out += [(names[agent[k]], int(rep[k]), bool(side), float(made[side, i])) for i, k in enumerate(own) for side in (0, 1) if made[side, i] == made[side, i]]
    return out
