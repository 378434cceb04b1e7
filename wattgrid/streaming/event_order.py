"""One series' samples in order of event time: what stateful operators do with the rows that are due.

All work on arrays; times are microseconds. A row is due once the watermark is later than it, since no
sample can come before it any more.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd

#: Columns of a counter's cells: step, samples, rise, rise that began in an earlier step, first and last time.
CELLS = (np.int64, np.int64, np.float64, np.float64, np.int64, np.int64)


def in_order(parts: Iterable[pd.DataFrame], held: Sequence[Sequence], columns: Sequence[str], watermark_us: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The rows that are due and those that wait, by time (the first column), of what was held and what has come."""
    new = [p[list(columns)] for p in parts]
    merged = [np.concatenate([np.asarray(old, np.int64 if k == 0 else None), *[p[c].to_numpy() for p in new]]) for k, (c, old) in enumerate(zip(columns, held))]
    order = np.lexsort(merged[::-1])
    merged = [m[order] for m in merged]
    due = int(np.searchsorted(merged[0], watermark_us, side="left"))
    return [m[:due] for m in merged], [m[due:] for m in merged]


def held_runs(us: np.ndarray, ok: np.ndarray, hold_us: int, idle_us: int, since: int | None, fired: bool, last: int | None) -> tuple[np.ndarray, np.ndarray, int | None, bool]:
    """Start and firing time of the runs that reach ``hold_us`` here, and the start of the run that is open at the end and whether it has fired.

    A sample that comes later than ``idle_us`` after the one before begins a run anew.
    """
    none = np.zeros(0, np.int64)
    if not len(us):
        return none, none, since, fired
    ok = ok.astype(bool)
    before = np.r_[since is not None, ok[:-1]]
    gap = us - np.r_[us[0] if last is None else last, us[:-1]]
    begins = ok & (~before | (gap > idle_us))
    run = np.cumsum(begins)  # 0 is the run that was open
    starts = np.r_[0 if since is None else since, us[begins]]
    met = np.flatnonzero(ok & (us - starts[run] >= hold_us) & ((run > 0) | (not fired)))
    which, first = np.unique(run[met], return_index=True)
    if ok[-1]:
        open_since, open_fired = int(starts[run[-1]]), bool(run[-1] in which or run[-1] == 0 and fired)
    else:
        open_since, open_fired = None, False
    return starts[which], us[met[first]], open_since, open_fired


#: Samples that runs are sought in at once: what one series brings is held as one number a sample, all else for so many.
SAMPLES_AT_ONCE = 1 << 20


def flags_in_order(parts: Iterable[pd.DataFrame], held: Sequence[Sequence], columns: Sequence[str], watermark_us: int) -> tuple[np.ndarray, np.ndarray]:
    """``in_order`` for a time and a flag, packed into one number (twice the time, plus the flag), 8 bytes a sample."""
    pack = lambda us, ok: np.asarray(us, np.int64) * 2 + np.asarray(ok, bool)
    packed = np.concatenate([pack(*held), *[pack(*(p[c].to_numpy() for c in columns)) for p in parts]])
    packed.sort()
    due = int(np.searchsorted(packed, watermark_us * 2, side="left"))
    return packed[:due], packed[due:]


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 1, (packed & 1).astype(bool)


def packed_runs(packed: np.ndarray, hold_us: int, idle_us: int, since: int | None, fired: bool, last: int | None) -> tuple[np.ndarray, np.ndarray, int | None, bool, int | None]:
    """``held_runs`` over packed samples, a bounded number of them at once, and the last time."""
    begun, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(packed), SAMPLES_AT_ONCE):
        us, ok = unpacked(packed[low:low + SAMPLES_AT_ONCE])
        b, m, since, fired = held_runs(us, ok, hold_us, idle_us, since, fired, last)
        begun.append(b)
        met.append(m)
        last = int(us[-1])
    return np.concatenate(begun), np.concatenate(met), since, fired, last


def silences(us: np.ndarray, limit_us: int, watermark_us: int, last: int | None, told: bool) -> tuple[np.ndarray, int | None, bool]:
    """Last times before silences longer than ``limit_us``, each once; then the last time and whether its silence is told."""
    if len(us):
        before = us[:-1] if last is None else np.r_[last, us[:-1]]
        long = us[len(us) - len(before):] - before > limit_us
        if last is not None and told:
            long[0] = False
        out, last, told = before[long], int(us[-1]), False
    else:
        out = np.zeros(0, np.int64)
    if last is not None and not told and watermark_us > last + limit_us:
        out, told = np.r_[out, last], True
    return out, last, told


def rises(us: np.ndarray, value: np.ndarray, last_us: int | None, last: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rise of each sample since the one before (NaN without one; a fall is a restart from 0), and that one's time."""
    before = np.r_[np.nan if last is None else last, value[:-1]]
    return np.where(value < before, value, value - before), np.r_[-1 if last_us is None else last_us, us[:-1]]


def counter_cells(us: np.ndarray, value: np.ndarray, step_us: int, last_us: int | None, last: float | None) -> list[np.ndarray]:
    """The samples reduced to one cell for each step that received some."""
    rise, before_us = rises(us, value, last_us, last)
    at = -(-us // step_us)
    enters = ~np.isnan(rise) & (-(-before_us // step_us) != at)
    names, first, number = np.unique(at, return_index=True, return_counts=True)
    rise = np.nan_to_num(rise)
    return [names, number, np.add.reduceat(rise, first), np.add.reduceat(np.where(enters, rise, 0.0), first), us[first], us[first + number - 1]]


def joined_cells(old: Sequence[Sequence], new: list[np.ndarray]) -> list[np.ndarray]:
    """Cells in order; the last old one and the first new one may be parts of one step."""
    old = [np.asarray(c, kind) for c, kind in zip(old, CELLS)]
    if len(old[0]) and len(new[0]) and old[0][-1] == new[0][0]:
        new[1][0] += old[1][-1]
        new[2][0] += old[2][-1]
        new[3][0], new[4][0] = old[3][-1], old[4][-1]
        old = [c[:-1] for c in old]
    return [np.concatenate(x) for x in zip(old, new)]


def window_rates(cells: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples and per-second rise of the window of ``steps`` steps that ends with each cell; NaN where it covers no time."""
    names, number, total, entering, first, until = cells
    low = np.searchsorted(names, names - steps, side="right")
    counts, sums = np.r_[0, np.cumsum(number)], np.r_[0.0, np.cumsum(total)]
    span = (until - first[low]) / 1e6
    rise = sums[1:] - sums[low] - entering[low]
    return counts[1:] - counts[low], np.divide(rise, span, out=np.full(len(span), np.nan), where=span > 0)
