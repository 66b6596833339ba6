"""A line search with sufficient decrease and curvature conditions, after More and Thuente (1994): an interval that holds a good step is kept,
and each trial is the safeguarded minimiser of cubics and quadratics through its ends."""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

#: Constants of the search: first step, decrease and curvature factors, range of steps, relative width that ends it, most evaluations, step on failure.
FIRST, DECREASE, CURVATURE, LEAST, MOST, WIDTH, TRIALS, FALLBACK = 1.0, 0.11111, 0.99999, 0.001, 4.0, 0.01, 40, 0.1


def _cubic(a: float, fa: float, ga: float, b: float, fb: float, gb: float) -> float:
    """Minimiser of the cubic through two points with their slopes."""
    d = 3 * (fa - fb) / (b - a) + ga + gb
    root = sqrt(max(0.0, d * d - ga * gb)) * (1 if b > a else -1)
    under = gb - ga + 2 * root
    return (a + b) / 2 if under == 0 else b - (b - a) * (gb + root - d) / under


def _secant(a: float, ga: float, b: float, gb: float) -> float:
    return (a + b) / 2 if ga == gb else b - gb * (b - a) / (gb - ga)


def _trial(low: tuple, high: tuple, now: tuple, bracketed: bool) -> float:
    """The next step from the best end, the other end and the step just tried, each (step, value, slope)."""
    (a, fa, ga), (t, ft, gt) = low, now
    if ft > fa:  # the minimum lies between
        c, q = _cubic(a, fa, ga, t, ft, gt), a + (t - a) * ga / (2 * ((fa - ft) / (t - a) + ga))
        return c if abs(c - a) < abs(q - a) else (c + q) / 2
    c, s = _cubic(a, fa, ga, t, ft, gt), _secant(a, ga, t, gt)
    if ga * gt < 0:
        return c if abs(c - t) >= abs(s - t) else s
    if abs(gt) <= abs(ga):  # slopes shrink: the nearer guess inside a bracket, the farther one outside
        ahead = c if (c - t) * (t - a) > 0 else s
        if not bracketed:
            return max(min(ahead, t + 4 * (t - a)), s) if t > a else min(max(ahead, t + 4 * (t - a)), s)
        pick = ahead if abs(ahead - t) < abs(s - t) else s
        edge = t + 0.66 * (high[0] - t)
        return min(pick, edge) if t > a else max(pick, edge)
    if bracketed:
        return _cubic(t, ft, gt, *high)
    return MOST if t > a else LEAST


def more_thuente(along: Callable[[float], tuple[float, float]], value: float, slope: float) -> float:
    """A step where ``along`` (value and slope at a step) has fallen enough and its slope flattened; ``FALLBACK`` if none is found.

    ``value`` and ``slope`` are those at 0; the direction must descend.
    """
    if slope >= 0:
        return FALLBACK
    low = high = (0.0, value, slope)
    bracketed, staged, step = False, True, FIRST
    width, before = MOST - LEAST, 2 * (MOST - LEAST)
    for _ in range(TRIALS):
        step = min(max(step, LEAST), MOST)
        now = (step, *along(step))
        limit = value + DECREASE * step * slope
        if now[1] <= limit and abs(now[2]) <= CURVATURE * -slope:
            return step
        if (step == MOST and now[1] <= limit and now[2] <= DECREASE * slope) or (step == LEAST and (now[1] > limit or now[2] >= DECREASE * slope)):
            return step
        if bracketed and abs(high[0] - low[0]) <= WIDTH * max(high[0], low[0]):
            return low[0] if low[0] > 0 else FALLBACK
        staged = staged and not (now[1] <= limit and now[2] >= min(DECREASE, CURVATURE) * slope)
        tilt = DECREASE * slope if staged and now[1] <= low[1] and now[1] > limit else 0.0
        lean = lambda p, tilt=tilt: (p[0], p[1] - tilt * p[0], p[2] - tilt)
        a, b, t = lean(low), lean(high), lean(now)
        step = _trial(a, b, t, bracketed)
        if t[1] > a[1]:
            high, bracketed = now, True
        else:
            if t[2] * (a[0] - t[0]) < 0:
                high, bracketed = low, True
            low = now
        if bracketed:
            inside = min(low[0], high[0]), max(low[0], high[0])
            if abs(high[0] - low[0]) >= 0.66 * before:
                step = low[0] + 0.5 * (high[0] - low[0])
            before, width = width, abs(high[0] - low[0])
            step = min(max(step, inside[0]), inside[1])
        else:
            step = min(max(step, now[0] + 1.1 * (now[0] - low[0])), now[0] + 4 * max(now[0] - low[0], now[0]))
    return low[0] if low[0] > 0 else FALLBACK
