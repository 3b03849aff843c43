"""Index-based numpy versions of the operators, for one series at a time."""

import numpy as np

CN = {2: 0.743, 3: 1.851, 4: 0.954, 5: 1.351, 6: 0.993, 7: 1.198, 8: 1.005, 9: 1.131}


def index_of(x, bound):
    if bound <= x[0]:
        return 0
    if bound >= x[-1]:
        return len(x) - 1
    return int(np.argmax(x >= bound))


def mask(x, y, left, right):
    gone = np.arange(index_of(x, left), index_of(x, right) + 1)
    return np.delete(x, gone), np.delete(y, gone)


def trim(x, y, left=None, right=None):
    lo, hi = x[0] if left is None else left, x[-1] if right is None else right
    if x[-1] <= 0 and hi >= 0:
        lo, hi = -hi, -lo
    a, b = index_of(x, lo), index_of(x, hi)
    return x[a:b], y[a:b]


def sn(w):
    n = len(w)
    high = [np.sort(np.abs(v - w))[n // 2] for v in w]
    low = np.sort(high)[(n - 1) // 2]
    c = CN.get(n, 1.0) if n <= 9 else (n / (n - 0.9) if n % 2 else 1.0)
    return 1.1926 * c * low


def impulse(y, width, tuning):
    h = width // 2
    out = y.copy()
    for i in range(len(y)):
        w = y[max(0, i - h) : i + h + 1]
        if abs(y[i] - np.median(w)) > tuning * sn(w):
            out[i] = np.median(w)
    return out


def grid(x, n):
    return np.arange(n) * ((x[-1] - x[0]) / n) + x[0]


def steffen(x, y, at, derivative=0):
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    d = np.empty(len(x))
    d[0], d[-1] = s[0], s[-1]
    for i in range(1, len(x) - 1):
        p = (s[i - 1] * h[i] + s[i] * h[i - 1]) / (h[i - 1] + h[i])
        d[i] = (np.sign(s[i - 1]) + np.sign(s[i])) * min(abs(s[i - 1]), abs(s[i]), abs(p) / 2)
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    u, a = at - x[j], (d[j] + d[j + 1] - 2 * s[j]) / h[j] ** 2
    b = (3 * s[j] - 2 * d[j] - d[j + 1]) / h[j]
    if derivative == 1:
        return d[j] + u * (2 * b + 3 * u * a)
    if derivative == 2:
        return 2 * b + 6 * u * a
    return y[j] + u * (d[j] + u * (b + u * a))


def spectrum(y, n, center=True, hann=True):
    m = len(y)
    y = y - y.mean() if center else y.copy()
    if hann:
        y = y * np.sin(np.arange(m) * np.pi / (m - 1)) ** 2
        y[0] = y[-1] = 0
    return np.abs(np.fft.rfft(y, n=n)) / m
