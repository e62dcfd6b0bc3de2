"""The two recursions over bars: the Kalman hedge ratio and the position rules. Both are causal: a bar's value
uses that bar and earlier ones only, and both can go on from a saved state."""

from __future__ import annotations

import numpy as np


def kalman_start(y: np.ndarray, x: np.ndarray) -> tuple[float, ...]:
    """(alpha, beta, p00, p01, p11, r) from a regression over the burn-in."""
    n = len(y)
    sx, sxx, sy, sxy = x.sum(), (x * x).sum(), y.sum(), (x * y).sum()
    det = n * sxx - sx * sx
    beta = (n * sxy - sx * sy) / det
    alpha = (sy - beta * sx) / n
    r = float(((y - alpha - beta * x) ** 2).sum() / (n - 2))
    return float(alpha), float(beta), r * sxx / det, -r * sx / det, r * n / det, r


def kalman_step(state: tuple[float, ...], y: float, x: float, delta: float) -> tuple[float, ...]:
    """The state after a bar of log prices."""
    a, b, p00, p01, p11, r = state
    q = delta / (1.0 - delta)
    p00, p11 = p00 + q, p11 + q
    h0, h1 = p00 + p01 * x, p01 + p11 * x
    s = h0 + x * h1 + r
    e = y - (a + b * x)
    return a + h0 / s * e, b + h1 / s * e, p00 - h0 * h0 / s, p01 - h0 * h1 / s, p11 - h1 * h1 / s, r


def kalman(y: np.ndarray, x: np.ndarray, burn_in: int, delta: float) -> np.ndarray:
    """(n - burn_in, 2) filtered alpha and beta of the bars after the burn-in."""
    if len(y) != len(x) or len(y) <= burn_in:
        raise ValueError("series must be equally long and longer than the burn-in")
    state = kalman_start(y[:burn_in], x[:burn_in])
    out = np.empty((len(y) - burn_in, 2))
    for i in range(burn_in, len(y)):
        state = kalman_step(state, y[i], x[i], delta)
        out[i - burn_in] = state[:2]
    return out


def position_step(pos: int, armed: bool, z: float, entry: float, exit: float, stop: float) -> tuple[int, bool]:
    """Position and whether an entry is armed after a bar with this z; a missing z changes nothing."""
    if z is None or z != z:
        return pos, armed
    if pos == 0:
        if abs(z) < entry:
            return 0, True
        if not armed:
            return 0, False
        return (0 if abs(z) >= stop else -1 if z > 0 else 1), False
    out = z >= stop or z <= exit if pos < 0 else z <= -stop or z >= -exit
    return (0 if out else pos), armed


def positions(z: np.ndarray, rules: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, last: bool = False):
    """Positions for many (entry, exit, stop) at once, one pass over the bars: (bars, rules), or (bars, series, rules) for z of several series.

    They go on from ``start``, positions and whether entries are armed by series and rule. With ``last`` only these are returned, as after the last bar."""
    entry, exit, stop = rules.T
    series = z.reshape(len(z), -1, 1)
    shape = (series.shape[1], len(rules))
    pos, armed = (np.broadcast_to(s, shape) for s in start) if start else (np.zeros(shape, np.int8), np.zeros(shape, bool))
    out = np.zeros((0 if last else len(z), *shape), dtype=np.int8)
    for i, v in enumerate(series):
        known = v == v
        if known.any():
            far, flat = np.abs(v), pos == 0
            inside = far < entry
            leaves = np.where(pos < 0, (v >= stop) | (v <= exit), (v <= -stop) | (v >= -exit))
            goes = flat & ~inside & armed & (far < stop)
            pos = np.where(known, np.where(goes, np.where(v > 0, -1, 1), np.where(~flat & leaves, 0, pos)), pos).astype(np.int8)
            armed = np.where(known & flat, inside, armed)
        if not last:
            out[i] = pos
    if last:
        return pos, armed
    return out[:, 0] if z.ndim == 1 else out


#: The six states of a rule: positions, and whether an entry is armed.
STATES = (np.array([-1, 0, 1, -1, 0, 1], np.int8)[:, None], np.array([False] * 3 + [True] * 3)[:, None])


def position_map(z: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """(6, rules): the state after these bars for each state before them. Maps of successive runs compose by indexing."""
    pos, armed = positions(np.repeat(z[:, None], 6, axis=1), rules, STATES, last=True)
    return (pos + 1 + 3 * armed).astype(np.int8)


def filter_element(y: np.ndarray, x: np.ndarray, delta: float, r: float) -> tuple[np.ndarray, ...]:
    """What a run of bars does to any state before it: (A, b, C, eta, J), combined pair by pair from those of single bars, which
    are associative (Sarkka and Garcia-Fernandez 2021)."""
    q, n = delta / (1.0 - delta), len(y)
    h = np.stack([np.ones(n), x], axis=1)
    s = q * (1.0 + x * x) + r
    eye = np.eye(2)
    gain = q * h / s[:, None]
    shrink = eye - gain[:, :, None] * h[:, None, :]
    now = (shrink, gain * y[:, None], q * shrink, h * (y / s)[:, None], h[:, :, None] * h[:, None, :] / s[:, None, None])
    while len(now[0]) > 1:
        odd = tuple(v[-1:] for v in now) if len(now[0]) % 2 else None
        half = len(now[0]) // 2
        now = combined(tuple(v[: 2 * half : 2] for v in now), tuple(v[1 : 2 * half : 2] for v in now))
        if odd:
            now = tuple(np.concatenate([v, o]) for v, o in zip(now, odd, strict=True))
    return tuple(v[0] for v in now)


def combined(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Elements of runs that follow each other, for many pairs of runs at once."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    times = lambda m, v: (m @ v[..., None])[..., 0]
    turn = lambda m: np.swapaxes(m, -1, -2)
    eye = np.eye(2)
    left, right = a2 @ np.linalg.inv(eye + c1 @ j2), turn(a1) @ np.linalg.inv(eye + j2 @ c1)
    return left @ a1, times(left, b1 + times(c1, e2)) + b2, left @ c1 @ turn(a2) + c2, times(right, e2 - times(j2, b1)) + e1, right @ j2 @ a1 + j1


def filter_after(state: tuple[float, ...], element: tuple[np.ndarray, ...]) -> tuple[float, ...]:
    """The filter's state (as of :func:`kalman_step`) after a run of bars."""
    m, p = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
    a, b, c, eta, j = element
    left = a @ np.linalg.inv(np.eye(2) + p @ j)
    m, p = left @ (m + p @ eta) + b, left @ p @ a.T + c
    return float(m[0]), float(m[1]), float(p[0, 0]), float((p[0, 1] + p[1, 0]) / 2), float(p[1, 1]), state[5]
