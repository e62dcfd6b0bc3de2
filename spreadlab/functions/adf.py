"""Unit-root statistics in numpy, from published formulas (Engle and Granger 1987; Said and Dickey 1984;
MacKinnon 1994, 2010)."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the response surface for two variables and a constant (MacKinnon 1994).
_TAU_MAX, _TAU_MIN, _TAU_STAR = 0.92, -18.86, -2.62
_SMALL_P = (2.92, 1.5012, 0.039796)
_LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    coefficients = _SMALL_P if tau <= _TAU_STAR else _LARGE_P
    x = sum(c * tau**i for i, c in enumerate(coefficients))
    return 0.5 * math.erfc(-x / math.sqrt(2.0))  # exact in its digits far out, too


def _design(u: np.ndarray, lags: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Left side and regressors (level, then lagged differences) from row ``drop`` of the differences on."""
    d = np.diff(u)
    n = len(d)
    cols = [u[drop:n], *[d[drop - k : n - k] for k in range(1, lags + 1)]]
    return d[drop:], np.column_stack(cols)


def most_lags(n: int) -> int:
    return min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), max(0, n // 2 - 2))


def adf_tau(u: np.ndarray) -> float:
    """t statistic of the level without constant; lags by least AIC on one common sample, then fitted anew on all
    rows that the chosen number leaves. One QR serves all numbers of lags, for the models are nested."""
    most = most_lags(len(u))
    y, x = _design(u, most, most)
    q, _ = np.linalg.qr(x)
    rss = float(y @ y) - np.cumsum((q.T @ y) ** 2)
    rss = np.maximum(rss, 1e-300)
    aic = len(y) * np.log(rss / len(y)) + 2.0 * np.arange(1, most + 2)
    lags = int(np.argmin(aic))
    y, x = _design(u, lags, lags)
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    rest = y - x @ b
    s2 = float(rest @ rest) / max(1, len(y) - x.shape[1])
    se = math.sqrt(max(s2 * inverse[0, 0], 0.0))
    return float(b[0]) / se if se > 0 else -math.inf


def engle_granger_p(y: np.ndarray, x: np.ndarray) -> float:
    """p value of no cointegration of y and x: regression with a constant, then the unit-root test of its residuals."""
    xc, yc = x - x.mean(), y - y.mean()
    sxx = float(xc @ xc)
    rest = yc - xc * (float(xc @ yc) / sxx if sxx > 0 else 0.0)
    if float(rest @ rest) <= 1e-20 * max(float(yc @ yc), 1e-300):
        return 0.0  # exactly collinear
    return mackinnon_p(adf_tau(rest))


#: Residuals smaller than this share of the levels' squares lose too many digits in a Gram matrix; such windows are fitted anew.
_LEAST_SHARE = 1e-6


class RollingEngleGranger:
    """Engle-Granger p values of strided windows of two series, each row used once for all windows.

    With u = y - a - b x, everything the unit-root test needs is a quadratic form in the levels of y and x and their lagged
    differences. Gram matrices of these are summed over the stretches between the starts and ends of windows; a window's matrix is the sum
    of its stretches', and a and b, which differ from window to window, come in afterwards. The few rows that a
    shorter lag adds at the start are added by themselves."""

    def __init__(self, y: np.ndarray, x: np.ndarray, window: int, step: int) -> None:
        self.raw, self.window = (y, x), window
        self.y, self.x = y - y.mean(), x - x.mean()
        self.dy, self.dx = np.diff(y), np.diff(x)
        self.most = most_lags(window)
        self.starts = range(0, len(y) - window + 1, step)
        self.levels = np.cumsum(np.column_stack([self.y, self.x, self.y * self.y, self.y * self.x, self.x * self.x]), axis=0)
        self.levels = np.concatenate([np.zeros((1, 5)), self.levels])
        self.stretches = self._stretches()

    def _rows(self, a: int, b: int, lags: int) -> np.ndarray:
        """One, levels before, and differences of both series at lags 0 to ``lags``, for the differences a to b."""
        cols = [np.ones(b - a), self.y[a:b], self.x[a:b]]
        for k in range(lags + 1):
            cols += [self.dy[a - k : b - k], self.dx[a - k : b - k]]
        return np.column_stack(cols)

    def _stretches(self) -> dict[int, tuple[int, np.ndarray]]:
        """By first row: the end and the Gram matrix of the rows up to it."""
        cuts = sorted({c for s in self.starts for c in (s + self.most, s + self.window - 1)})
        out = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = self._rows(a, b, self.most)
            out[a] = (b, rows.T @ rows)
        return out

    def _gram(self, start: int) -> np.ndarray:
        at, total = start + self.most, 0.0
        while at < start + self.window - 1:
            at, part = self.stretches[at]
            total = total + part
        return total

    @staticmethod
    def _of_residuals(gram: np.ndarray, a: float, b: float, turned: bool) -> np.ndarray:
        """The Gram matrix of u's level and its differences at each lag."""
        size = len(gram)
        change = np.zeros((size, (size - 3) // 2 + 1))
        own, other = (2, 1) if turned else (1, 2)
        change[0, 0], change[own, 0], change[other, 0] = -a, 1.0, -b
        for k in range(change.shape[1] - 1):
            change[3 + 2 * k + own - 1, k + 1], change[3 + 2 * k + other - 1, k + 1] = 1.0, -b
        return change.T @ gram @ change

    def _tau(self, start: int, gram: np.ndarray, a: float, b: float, turned: bool) -> float:
        def split(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            regressors = np.delete(np.arange(len(g)), 1)
            return g[np.ix_(regressors, regressors)], g[regressors, 1], float(g[1, 1])

        rows = self.window - 1 - self.most
        x, xy, yy = split(self._of_residuals(gram, a, b, turned))
        unit = np.sqrt(np.diag(x))
        z = np.linalg.solve(np.linalg.cholesky(x / np.outer(unit, unit)), xy / unit)
        rss = np.maximum(yy - np.cumsum(z * z), 1e-300)
        lags = int(np.argmin(rows * np.log(rss / rows) + 2.0 * np.arange(1, self.most + 2)))
        more = self._rows(start + lags, start + self.most, lags)
        size = 3 + 2 * (lags + 1)
        x, xy, yy = split(self._of_residuals(gram[:size, :size] + more.T @ more, a, b, turned))
        inverse = np.linalg.pinv(x)
        slope = inverse @ xy
        s2 = max(yy - float(slope @ xy), 0.0) / max(1, self.window - 1 - lags - len(x))
        se = math.sqrt(max(s2 * inverse[0, 0], 0.0))
        return float(slope[0]) / se if se > 0 else -math.inf

    def p_values(self) -> list[tuple[int, float, float]]:
        """(last row, p of y on x, p of x on y) of each window."""
        out = []
        for s in self.starts:
            n, end = self.window, s + self.window
            sy, sx, syy, sxy, sxx = self.levels[end] - self.levels[s]
            gram = self._gram(s)
            both = []
            for turned, (m1, m2, v1, v2) in ((False, (sy, sx, syy, sxx)), (True, (sx, sy, sxx, syy))):
                c12, c22, c11 = sxy - sy * sx / n, v2 - m2 * m2 / n, v1 - m1 * m1 / n
                b = c12 / c22 if c22 > 0 else 0.0
                try:
                    if not c22 > _LEAST_SHARE * v2 or not c11 - b * c12 > _LEAST_SHARE * max(v1, b * b * v2):
                        raise np.linalg.LinAlgError
                    p = mackinnon_p(self._tau(s, gram, (m1 - b * m2) / n, b, turned))
                except np.linalg.LinAlgError:
                    pair = [r[s:end] for r in self.raw]
                    p = engle_granger_p(*(pair[::-1] if turned else pair))
                both.append(p)
            out.append((end - 1, *both))
        return out
